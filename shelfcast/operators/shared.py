"""Helpers used by several operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.schemas import HOME_RATES


def share_of_total(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Percent of the column total.

    The total is a scalar subquery: every row keeps its partition, where ``sum() OVER ()`` would
    move them all into one task.
    """
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(name, F.try_divide(F.lit(100.0) * F.col(value), total))


def home_currency(
    amount: Column, coin: Column, rates: Mapping[str, float] = HOME_RATES, unknown: str = "one"
) -> Column:
    """Amount at fixed rates; an unknown coin counts at rate 1 (``'one'``) or as NULL."""
    if unknown not in ("one", "null"):
        raise ValueError(f"unknown must be 'one' or 'null', not {unknown!r}")
    rate = F.lit(1.0) if unknown == "one" else F.lit(None).cast("double")
    for code, value in rates.items():
        rate = F.when(coin == code, F.lit(float(value))).otherwise(rate)
    return amount.cast("double") * rate


def top_items(totals: DataFrame, key: str, value: str, k: int, ascending: bool = False) -> DataFrame:
    """The ``k`` keys of largest (or smallest) value, ties by key; NULL keys never rank."""
    order = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    return totals.where(F.col(key).isNotNull()).orderBy(order, key).limit(k)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into as many partitions as the session shuffles to.

    For steps whose output is far larger than their input: adaptive execution merges shuffle
    partitions by input size, a partition number given here is kept.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys)
