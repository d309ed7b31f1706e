"""Panels and results stored in buckets by series, so that work by series reads them unshuffled."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Buckets of a table unless a caller names another number: work by series has as many tasks.
BUCKETS = 64


def store_by_series(
    df: DataFrame, path: str, buckets: int = BUCKETS, key: str = "unique_id", order: str = "ds"
) -> None:
    """Write ``df`` below ``path`` in ``buckets`` of the series' hash, a file each, sorted by series
    and date. A table that is there is replaced."""
    name = f"by_series_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, order)
        .option("path", path).saveAsTable(name)
    )
    # the files stay: the name belongs to this session only
    df.sparkSession.sql(f"DROP TABLE {name}")


def open_by_series(
    spark: SparkSession, path: str, schema: T.StructType, buckets: int = BUCKETS, key: str = "unique_id", order: str = "ds"
) -> DataFrame:
    """What ``store_by_series`` wrote with the same number of buckets, in any session.

    Groups, windows and joins by the series find its rows together, without an exchange.
    """
    name = f"by_series_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    place = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`, `{order}`) "
        f"INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return spark.table(name)
