"""Monthly demand panels ``(unique_id, ds, y)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.filters import Scope
from shelfcast.operators.shared import spread

# Fixed values: (suffix, start, length) of the item-code levels above the item itself.
LEVELS = [("_category", 0, 2), ("_catalog", 2, 3), ("_catalog+color", 2, 6)]


def monthly_quantities(stock_log: DataFrame, scope: Scope) -> DataFrame:
    """Quantity per item and observed month, months labelled by their last day."""
    return (
        scope.stock(stock_log, "cur_date").where(F.col("item").isNotNull())
        .groupBy("item", F.last_day(F.to_date("cur_date")).alias("ds"))
        .agg(F.sum(F.col("quantity").cast("double")).alias("y"))
    )


def densify(monthly: DataFrame, key: str) -> DataFrame:
    """Every key gets every month observed anywhere, missing ones with 0.

    Each row fills the gap up to its key's next month, so the zeros appear inside the partitions
    of one window and are never shuffled. The observed months are one calendar-sized array. It
    is asked for together with a value of ``y``: the subquery then needs the same columns as the
    main branch and reads the shuffle that one wrote, instead of scanning again.
    """
    observed = monthly.agg(
        F.struct(F.array_sort(F.collect_set("ds")).alias("months"), F.max("y").alias("top"))
    ).scalar()
    by_key = Window.partitionBy(key).orderBy("ds")
    here = F.array_position("months", F.col("ds"))
    first = F.when(F.col("_previous").isNull(), F.lit(1)).otherwise(here).cast("int")
    after = F.coalesce(F.array_position("months", F.col("_next")), F.size("months") + 1).cast("int")
    return (
        spread(monthly, key)
        .select(
            key, "ds", "y", F.lag("ds").over(by_key).alias("_previous"),
            F.lead("ds").over(by_key).alias("_next"),
        )
        .withColumn("months", observed["months"])
        .select(
            key, "y", F.col("ds").alias("_ds"),
            F.explode(F.slice("months", first, after - first)).alias("ds"),
        )
        .select(
            key, "ds",
            F.when(F.col("ds") == F.col("_ds"), F.coalesce("y", F.lit(0.0))).otherwise(0.0).alias("y"),
        )
    )


def densify_panel(stock_log: DataFrame, scope: Scope) -> DataFrame:
    """Month sums per item over observed months x observed items."""
    return densify(monthly_quantities(stock_log, scope), "item")


def hierarchy_rollup(item_months: DataFrame) -> DataFrame:
    """Sum every item into four series: itself, its category, catalog and catalog+colour."""
    ids = F.array(
        F.col("item"),
        *[
            F.concat(F.substring("item", start + 1, length), F.lit(suffix))
            for suffix, start, length in LEVELS
        ],
    )
    return (
        item_months.select("ds", "y", F.explode(ids).alias("unique_id"))
        .groupBy("unique_id", "ds").agg(F.sum("y").alias("y"))
    )


def hierarchy_level(unique_id: Column) -> Column:
    """Level name of a series id, for partitioned writes."""
    level = F.lit("item")
    for suffix, _, _ in LEVELS:
        level = F.when(unique_id.endswith(suffix), F.lit(suffix[1:])).otherwise(level)
    return level


def build_panel(stock_log: DataFrame, scope: Scope) -> DataFrame:
    """``hierarchy_rollup`` of ``densify_panel``, with the zeros added last.

    Adding zeros and summing commute, so only observed item-months are shuffled.
    """
    return densify(hierarchy_rollup(monthly_quantities(stock_log, scope)), "unique_id")


def extend_series(panel: DataFrame, horizon: int = 12) -> DataFrame:
    """Months missing inside a series with NULL, plus ``horizon`` months after the last month of
    the whole panel."""
    panel_end = panel.agg(
        F.struct(F.max("ds").alias("ds"), F.max("y").alias("top"))
    ).scalar()["ds"]
    by_series = Window.partitionBy("unique_id").orderBy("ds")
    month = F.expr("interval 1 month")
    here, end = F.trunc("ds", "MM"), F.trunc("_end", "MM")
    gap = F.sequence(here, F.add_months(F.trunc("_next", "MM"), -1), month)
    future = F.sequence(F.add_months(end, 1), F.add_months(end, horizon), month)
    starts = F.when(F.col("_next").isNotNull(), gap).otherwise(F.concat(F.array(here), future))
    return (
        panel.select("unique_id", "ds", "y", F.lead("ds").over(by_series).alias("_next"))
        .withColumn("_end", panel_end)
        .select("unique_id", "y", F.col("ds").alias("_ds"), F.explode(starts).alias("_month"))
        .select("unique_id", "y", "_ds", F.last_day("_month").alias("ds"))
        .select("unique_id", "ds", F.when(F.col("ds") == F.col("_ds"), F.col("y")).alias("y"))
    )


def time_index_split(panel: DataFrame, test_start: str) -> DataFrame:
    """Dense 0-based month index and train / test label.

    The test part begins with the month-end of ``test_start``; a month missing from the panel is
    an error.
    """
    # the months are one calendar-sized array, asked for with a value of y as in ``densify``
    months = panel.agg(
        F.struct(F.array_sort(F.collect_set("ds")).alias("months"), F.max("y").alias("top"))
    ).scalar()["months"]
    test_ds = F.last_day(F.lit(test_start).cast("date"))
    return (
        panel.withColumn("_months", months)
        .withColumn("_first", F.array_position("_months", test_ds))
        .withColumn(
            "_first",
            F.when(F.col("_first") > 0, F.col("_first")).otherwise(
                F.raise_error(F.lit(f"no rows in the test month of {test_start}")).cast("long")
            ),
        )
        .withColumn("time_idx", (F.array_position("_months", F.col("ds")) - 1).cast("int"))
        .withColumn("part", F.when(F.col("time_idx") < F.col("_first") - 1, "train").otherwise("test"))
        .drop("_months", "_first")
    )
