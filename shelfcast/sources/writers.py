"""Table and file sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.operators.panel import hierarchy_level
from shelfcast.sources.readers import RESCUED, SOURCE

#: Most tasks that write one partition of a table, and rows of a file.
FILES = 16
FILE_ROWS = 5_000_000
_WRITE_MODES = ("append", "overwrite", "overwrite_partitions")


def append_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "append"
) -> None:
    """Write Parquet below ``path``.

    ``append`` adds rows, so a repeated run duplicates them; ``overwrite_partitions`` replaces
    just the partitions present in ``df``, so a repeated run leaves the same table.
    """
    if mode not in _WRITE_MODES:
        raise ValueError(f"unknown write mode {mode!r}")
    writer = df.write
    if partition_by:
        # a few files for each partition, however many tasks there are; a large one is spread
        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(FILES))
        writer = df.repartition(*partition_by, salt).write.partitionBy(*partition_by)
        writer = writer.option("maxRecordsPerFile", FILE_ROWS)
    if mode == "overwrite_partitions":
        if not partition_by:
            raise ValueError("overwrite_partitions needs partition columns")
        writer = writer.option("partitionOverwriteMode", "dynamic").mode("overwrite")
    else:
        writer = writer.mode(mode)
    writer.parquet(path)


def append_once(df: DataFrame, path: str, run: str, keys: Sequence[str]) -> None:
    """Append the rows of a run whose ``keys`` no other run has written.

    A run owns the partition ``run=<run>`` of the table and of its manifest, the table of written
    keys beside it, and replaces both when it is repeated: after a failure at any point, a second try
    leaves the rows of one. The manifest is written behind the table. Rows that repeat a key within
    the run are all kept; null keys equal each other.
    """
    manifest = f"{path.rstrip('/')}-manifest"
    if not keys:
        raise ValueError("append_once needs key columns")
    rows = df
    spark = df.sparkSession
    known = [f for f in df.schema.fields if f.name in keys]
    schema = T.StructType([*known, T.StructField("run", T.StringType())])
    if _exists(spark, manifest):
        others = spark.read.schema(schema).parquet(manifest).where(F.col("run") != run).select(
            *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]
        )
        same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        rows = df.join(others, same, "left_anti")
    owned = rows.withColumn("run", F.lit(run))
    written = {"partitionOverwriteMode": "dynamic", "maxRecordsPerFile": str(FILE_ROWS)}
    owned.write.options(**written).mode("overwrite").partitionBy("run").parquet(path)
    mine = spark.read.schema(T.StructType([*df.schema.fields, schema["run"]])).parquet(path).where(F.col("run") == run)
    mine.select(*keys, "run").distinct().write.options(**written).mode("overwrite").partitionBy("run").parquet(manifest)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path``, in whatever store the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV part files with a header; quotes inside values are doubled."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def store_results(results: DataFrame, path: str, mode: str = "overwrite_partitions") -> None:
    """Write a forecast grid partitioned by hierarchy level, so readers of one level skip the rest
    and a repeated run replaces the levels it computed."""
    levelled = results.withColumn("level", hierarchy_level(F.col("unique_id")))
    append_table(levelled, path, ["level"], mode)


def filter_and_publish(
    results: DataFrame, path: str, unique_ids: Sequence[str], mode: str = "append", run: str | None = None
) -> None:
    """Append the rows of the chosen series to a published table.

    With a ``run`` key, points that an earlier run has published are left out, and a repeated run
    replaces its own rows.
    """
    chosen = results.where(F.col("unique_id").isin(list(unique_ids)))
    if run is None:
        append_table(chosen, path, mode=mode)
    else:
        append_once(chosen, path, run, ["unique_id", "ds"])


def quarantine(rows: DataFrame, good: str, bad: str) -> None:
    """Write the rows that fit their schema to the table ``good`` and the texts of the others, with
    their file, to ``bad``. ``rows`` come from ``load_delimited(..., rescued=True)``."""
    fits = F.col(RESCUED).isNull()
    rows.where(fits).drop(RESCUED, SOURCE).write.mode("append").parquet(good)
    rows.where(~fits).select(RESCUED, SOURCE).write.mode("append").parquet(bad)
