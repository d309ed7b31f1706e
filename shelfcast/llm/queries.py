"""The operators over the supplied tables, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import (
    alignment, decontaminate, exact_dedup, line_dedup, merkle, near_dedup, packing, resharding, secrets, substring_dedup,
    token_matrices, toxicity, warc,
)
from shelfcast.llm.storage import read
from shelfcast.session import scratch_path

#: Names of the vocabulary files.
VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"

OLD_SHARDS, NEW_SHARDS = 5, 8

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"), digest_all=True)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_strings(read(spark, sf_dir, "documents")).drop("spans")


def vocabulary(name: str = VOCABULARY) -> str:
    """Place of a vocabulary file, which is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary(), with_ids=False).drop("ids")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    return found.where("is_secret").select("doc_id", "position", "key", "value", F.round("probability", 6).alias("probability"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(read(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op7_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = token_matrices.write_matrices(
        read(spark, sf_dir, "documents"), vocabulary(), scratch_path(spark, "token-matrices")
    )
    return token_matrices.pieces(written)


def op8_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = resharding.reshard(
        read(spark, sf_dir, "documents"), scratch_path(spark, "shards"), OLD_SHARDS, NEW_SHARDS
    )
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaked_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = merkle.tampered(F.col("text"), F.col("doc_id"))
    return merkle.manifest(read(spark, sf_dir, "documents"), claimed).drop("witness")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(read(spark, sf_dir, "documents"), vocabulary(), vocabulary(PIECES), with_groups=False)
    return aligned.drop("groups")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_repeated_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_suffix_array_dedup": op2_suffix_array_dedup,
        "op3_packing": op3_packing,
        "op4_secret_scan": op4_secret_scan,
        "op5_toxicity": op5_toxicity,
        "op6_warc": op6_warc,
        "op7_token_matrices": op7_token_matrices,
        "op8_resharding": op8_resharding,
        "op9_decontamination": op9_decontamination,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_token_alignment": op12_token_alignment,
        "op13_line_dedup": op13_line_dedup,
    }
