"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.storage import small_enough, staged

#: Characters that don't count: ``[\x20\x09-\x0D]``.
IGNORED = "\x20\x09\x0a\x0b\x0c\x0d"
PREFIX = 128


def normalised(text: Column) -> Column:
    """The text without white space; byte searches, no regular expression. Null is empty."""
    out = F.coalesce(text, F.lit(""))
    for char in IGNORED:
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same after ``normalised``. Of equal texts the row with most
    code points in its original text stays, then the one with the smallest id.

    1. One scan gives each row its normalised length and a hash of the first ``PREFIX`` normalised
       characters. Rows alone with their length, then alone with length and prefix, are settled:
       they are their own group.
    2. Only the others have their whole text hashed, and are grouped by that.

    Texts never leave their scan: what is shuffled are numbers and digests. Groups are found by
    aggregates with a partial step, so a group with a third of all rows is one row per task; the
    joins back are on keys whose hot partitions Spark splits.

    text_sha256 is null for settled rows unless ``digest_all``, where every row is hashed.
    Null texts are empty texts, and empty texts equal each other. Rows that repeat an id and a text
    are copies: one of them is kept. Null ids count after all others, and rows of equal text that
    all lack an id keep one of them. Other columns are not looked at. An empty table gives none.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    bare = normalised(text)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), bare.alias("bare"))
    narrow = staged(
        rows.select(
            "id", F.length("text").alias("points"), F.octet_length("bare").alias("length"),
            F.xxhash64(F.substring("bare", 1, PREFIX)).alias("prefix"),
        ),
        "dedup-lengths",
    )

    shared_length = staged(narrow.groupBy("length").count().where("count > 1").select("length"), "dedup-shared")
    by_length = narrow.join(small_enough(shared_length, 16), "length", "left_semi")
    shared_prefix = staged(
        by_length.groupBy("length", "prefix").count().where("count > 1").drop("count"), "dedup-shared"
    )
    open_ids = staged(
        by_length.join(small_enough(shared_prefix, 32), ["length", "prefix"], "left_semi")
        .select("id").distinct(),
        "dedup-open",
    )

    marked = open_ids.select(F.col("id").alias("open_id"), F.lit(True).alias("open"))
    same_id = F.col("id").eqNullSafe(F.col("open_id"))
    sha = F.sha2(F.col("bare").cast("binary"), 256)
    if digest_all:
        # every text is hashed in its scan and only the digest meets the open ids
        hashed = rows.select(
            "id", F.length("text").alias("points"), F.octet_length("bare").alias("length"), sha.alias("sha")
        ).join(small_enough(marked, 32), same_id, "left")
        hashed = hashed.select("id", "points", "length", "sha", F.coalesce("open", F.lit(False)).alias("open"))
    else:
        still = rows.join(small_enough(marked, 32), same_id, "left_semi").select(
            "id", F.length("text").alias("points"), F.octet_length("bare").alias("length"),
            sha.alias("sha"), F.lit(True).alias("open"),
        )
        settled = narrow.join(marked, same_id, "left_anti").select(
            "id", "points", "length", F.lit(None).cast("string").alias("sha"), F.lit(False).alias("open")
        )
        hashed = still.unionByName(settled)
    hashed = staged(hashed, "dedup-hashes")

    # rows that repeat id and text are counted once here and told apart by a number at the end
    members = hashed.where("open").groupBy("id", "points", "length", "sha").agg(F.count(F.lit(1)).alias("copies"))
    groups = staged(members.groupBy("length", "sha").agg(
        F.sum("copies").alias("group_size"),
        F.max(F.struct("points", F.col("id").isNotNull().alias("named"), (-F.col("id")).alias("minus_id"))).alias("best"),
    ).where("group_size > 1").select(
        "length", "sha", "group_size", (-F.col("best.minus_id")).alias("keep_id"),
        F.col("best.points").alias("keep_points"),
    ), "dedup-groups")
    grouped = members.join(groups, ["length", "sha"], "left").select(
        "id", F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        "sha", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
        (F.col("keep_points").isNull() | (F.col("points") == F.col("keep_points"))).alias("fits"),
    )
    alone = hashed.where("NOT open").select(
        "id", F.lit(1).cast("long").alias("group_size"), F.col("id").alias("keep_id"), "sha",
        F.lit(1).alias("copy"), F.lit(True).alias("fits"),
    )
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & F.col("fits") & (F.col("copy") == 1)
    return grouped.unionByName(alone).select(
        F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        kept.alias("kept"), F.col("sha").alias("text_sha256"),
    )
