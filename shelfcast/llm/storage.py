"""Written tables between the steps of an operator, and row-level helpers all operators share."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.session import scratch_path

#: Upper bound, in bytes of the written table, of a side that is broadcast on purpose.
BROADCAST_BYTES = 16 << 20


#: Largest batch of rows that Spark hands to a Python worker; one row may be larger.
BATCH_BYTES = 8 << 20


@functools.cache
def _shipped(spark: SparkSession) -> None:
    """Bound what Python workers get at once, and give them this package unless their search path
    has it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    root = Path(__file__).resolve().parents[2]
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if context.master.startswith("local") and any(p and Path(p).resolve() == root for p in found):
        return
    # the driver serves this file to the executors
    folder = tempfile.mkdtemp(prefix="shelfcast-code-")
    context.addPyFile(shutil.make_archive(f"{folder}/shelfcast-code", "zip", root, root.joinpath("shelfcast").name))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared scratch folder and read again.

    A lost executor then costs a read of a committed file, never the work before it.
    """
    _shipped(df.sparkSession)
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(table: DataFrame, bytes_per_row: int) -> DataFrame:
    """``table`` with a broadcast hint if its counted rows stay below ``BROADCAST_BYTES``.

    Beyond that the join is left to Spark, which shuffles both sides. ``table`` has to be staged,
    so that counting reads Parquet footers only.
    """
    return F.broadcast(table) if table.count() * bytes_per_row <= BROADCAST_BYTES else table


def drop_ids(docs: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id isn't among ``dropped``; rows without id stay, nothing names them."""
    gone = staged(
        dropped.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__gone")).distinct(),
        "dropped-ids",
    )
    gone = small_enough(gone, 32)
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
