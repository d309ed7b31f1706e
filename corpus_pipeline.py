"""From raw documents to packed training sequences: ordered stages over the llm operators.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and gives the documents it
keeps, with all their columns; the last one gives packed pieces. ``run`` writes each stage's rows to
the shared scratch folder and reads them as the next one's documents.

Rows without a doc_id pass the filters by id (nothing names them) and are packed like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from shelfcast.llm.queries import vocabulary
from shelfcast.llm.storage import drop_ids, read, staged


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic by a model of this table's labels go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space stays.

    Of rows that repeat an id and a text, one stays; an id with several texts keeps one row of each
    as long as one of its rows is kept.
    """
    groups = exact_dedup.exact_duplicates(docs)
    by_id = staged(
        groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")),
        "exact-ids",
    )
    docs = drop_ids(docs, by_id.where("NOT kept").select("doc_id"), "doc_id")
    repeated = by_id.where("kept AND n > 1").select("doc_id")
    if repeated.isEmpty():
        return docs
    order = Window.partitionBy("doc_id", F.sha2(exact_dedup.normalised(F.col("text")).cast("binary"), 256)).orderBy(
        F.desc(F.length("text"))
    )
    one = docs.join(repeated, "doc_id", "left_semi").withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return drop_ids(docs, repeated, "doc_id").unionByName(one.drop("__n").select(*docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates stays."""
    return drop_ids(docs, near_dedup.near_duplicates(docs).where("NOT kept").select("doc_id"), "doc_id")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return drop_ids(docs, decontaminate.leaked_passages(docs, read(spark, sf_dir, "benchmark")), "doc_id")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in full windows, one row per piece."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Tokens, sketches and models can't be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the table ``documents`` below ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
