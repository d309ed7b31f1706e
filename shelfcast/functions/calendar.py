"""Calendar periods, spines and gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STEPS = {
    "D": "interval 1 day",
    "W": "interval 7 days",
    "M": "interval 1 month",
    "Q": "interval 3 months",
    "Y": "interval 1 year",
}


def known_freq(freq: str) -> str:
    """``no_agg`` and unknown frequencies mean daily."""
    return freq if freq in _STEPS else "D"


def period_start(column: Column | str, freq: str, week_label: str = "start") -> Column:
    """First day of the period; weeks start on Sunday.

    ``week_label='end'`` labels Monday-to-Sunday weeks by their closing Sunday instead.
    """
    day = F.to_date(column)
    freq = known_freq(freq)
    if freq == "W":
        if week_label == "end":
            return F.next_day(F.date_sub(day, 1), "SUN")
        return F.date_sub(day, F.dayofweek(day) - 1)
    unit = {"M": "MM", "Q": "QUARTER", "Y": "YEAR"}.get(freq)
    return F.trunc(day, unit) if unit else day


def period_label(period: Column | str, freq: str) -> Column:
    """``YYYY-MM`` for months, ``YYYY`` for years, else the ISO day."""
    pattern = {"M": "yyyy-MM", "Y": "yyyy"}.get(freq, "yyyy-MM-dd")
    return F.date_format(period, pattern)


def period_range(start: str, end: str, freq: str, week_label: str = "start") -> Column:
    """Array of every period that touches ``start``..``end``."""
    first, last = (
        period_start(F.lit(day).cast("date"), freq, week_label) for day in (start, end)
    )
    return F.sequence(first, last, F.expr(_STEPS[known_freq(freq)]))


def period_spine(
    spark: SparkSession, start: str, end: str, freq: str, name: str = "period",
    week_label: str = "start",
) -> DataFrame:
    """One row per period; its size is the calendar length, not the data's."""
    return spark.range(0, 1, 1, 1).select(
        F.explode(period_range(start, end, freq, week_label)).alias(name)
    )


def with_spine(rows: DataFrame, spine: DataFrame) -> DataFrame:
    """Add one all-null row per spine entry ahead of an aggregation.

    The group of every spine entry then exists after ONE shuffle, without a join: sums and
    averages of a padded group are null (coalesce them), counts of a column are 0.
    """
    return rows.unionByName(spine, allowMissingColumns=True)


def calendar_fill(
    df: DataFrame, date_column: str, values: Sequence[str], start: str, end: str, freq: str,
    keys: Sequence[str] = (), fill: float = 0.0, week_label: str = "start",
) -> DataFrame:
    """Sum ``values`` per period (and key); periods without rows get ``fill``, rows of periods
    outside the range are dropped.

    Only additive values may be filled this way; distinct counts need their own pass.
    """
    first, last = (period_start(F.lit(d).cast("date"), freq, week_label) for d in (start, end))
    rows = df.select(
        *keys, period_start(date_column, freq, week_label).alias("period"),
        *[F.col(v).cast("double").alias(v) for v in values],
    ).where(F.col("period").between(first, last))
    sums = [F.sum(v).alias(v) for v in values]
    if not keys:
        spine = period_spine(df.sparkSession, start, end, freq, week_label=week_label)
        return with_spine(rows, spine).groupBy("period").agg(
            *[F.coalesce(F.sum(v), F.lit(fill)).alias(v) for v in values]
        )
    # At most one entry per period and key is left here, so a map per key is calendar-sized.
    per_key = rows.groupBy(*keys, "period").agg(*sums).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("period", F.struct(*values)))).alias("_known")
    )
    return per_key.select(
        *keys, "_known", F.explode(period_range(start, end, freq, week_label)).alias("period")
    ).select(
        *keys, "period",
        *[
            F.coalesce(F.try_element_at("_known", F.col("period"))[v], F.lit(fill)).alias(v)
            for v in values
        ],
    )
