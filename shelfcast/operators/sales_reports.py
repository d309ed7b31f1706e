"""Reports on the sales table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast import schemas
from shelfcast.functions.calendar import (
    calendar_fill, period_range, period_spine, period_start, with_spine,
)
from shelfcast.functions.classify import single_word_class, two_word_class, two_word_labels
from shelfcast.functions.filters import Scope, measure, measure_name
from shelfcast.operators.shared import home_currency, top_items

# Order of the weekday report.
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def period_totals(
    sales: DataFrame, scope: Scope, what: str = "income", week_label: str = "start"
) -> DataFrame:
    """Measure per period, zero-filled over the requested range."""
    return calendar_fill(
        scope.sales(sales), "status_date", [measure_name(what)], scope.start, scope.end,
        scope.freq, week_label=week_label,
    )


def topk_item_series(
    sales: DataFrame, scope: Scope, what: str = "income", k: int = 7
) -> DataFrame:
    """Zero-filled series of the ``k`` items with the largest totals, in long form."""
    value = measure_name(what)
    rows = scope.sales(sales)
    totals = rows.groupBy("item").agg(F.sum(measure(what)).alias("total"))
    top = top_items(totals, "item", "total", k).select("item")
    grid = top.select(
        "item", F.explode(period_range(scope.start, scope.end, scope.freq)).alias("period")
    )
    # k names: broadcast, so that the second pass drops other items before its shuffle
    kept = rows.join(F.broadcast(top), "item", "left_semi").select(
        "item", period_start("status_date", scope.freq).alias("period"),
        measure(what).alias(value),
    )
    return (
        with_spine(kept, grid)
        .groupBy("period", "item").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))
    )


def topk_item_wide(series: DataFrame, value: str, items: Sequence[str] | None = None) -> DataFrame:
    """One column per item of a long ``topk_item_series``. The columns are ``items``; without them a
    job looks up the series' own k items."""
    columns = list(items) if items is not None else None
    return series.groupBy("period").pivot("item", columns).agg(F.sum(value)).orderBy("period")


def topk_and_others(
    sales: DataFrame, scope: Scope, what: str = "income", k: int = 10
) -> DataFrame:
    """Totals of the ``k`` largest items and one ``others`` bucket, descending."""
    value = measure_name(what)
    totals = scope.sales(sales).groupBy("item").agg(F.sum(measure(what)).alias(value))
    top = top_items(totals, "item", value, k).select("item", F.col("item").alias("top_item"))
    return (
        totals.join(F.broadcast(top), "item", "left")
        .groupBy(F.coalesce("top_item", F.lit("others")).alias("item_bucket"))
        .agg(F.sum(value).alias(value))
        .orderBy(F.col(value).desc(), "item_bucket")
    )


def _daily_totals(sales: DataFrame, scope: Scope, what: str) -> DataFrame:
    return (
        scope.sales(sales).groupBy(F.to_date("status_date").alias("day"))
        .agg(F.sum(measure(what)).alias("total"))
    )


def avg_by_weekday(sales: DataFrame, scope: Scope, what: str = "income") -> DataFrame:
    """Mean of the daily totals per weekday, Sunday to Saturday, absent weekdays 0."""
    days = _daily_totals(sales, scope, what).select(
        F.date_format("day", "EEEE").alias("day_of_week"), "total"
    )
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    spine = sales.sparkSession.range(0, 1, 1, 1).select(F.explode(names).alias("day_of_week"))
    return (
        with_spine(days, spine).groupBy("day_of_week")
        .agg(F.coalesce(F.avg("total"), F.lit(0.0)).alias(f"avg_{measure_name(what)}"))
        .orderBy(F.array_position(names, F.col("day_of_week")))
    )


def avg_by_day_of_month(sales: DataFrame, scope: Scope, what: str = "income") -> DataFrame:
    """Mean of the daily totals per day of month 1 to 31, absent days 0."""
    days = _daily_totals(sales, scope, what).select(
        F.dayofmonth("day").alias("day_of_month"), "total"
    )
    spine = sales.sparkSession.range(1, 32, 1, 1).select(
        F.col("id").cast("int").alias("day_of_month")
    )
    return (
        with_spine(days, spine).groupBy("day_of_month")
        .agg(F.coalesce(F.avg("total"), F.lit(0.0)).alias(f"avg_{measure_name(what)}"))
        .orderBy("day_of_month")
    )


def avg_by_month(sales: DataFrame, scope: Scope, what: str = "income") -> DataFrame:
    """Mean of the ROW values per month of year, months without rows left out."""
    return (
        scope.sales(sales).groupBy(F.month("status_date").alias("month"))
        .agg(F.avg(measure(what)).alias(f"avg_{measure_name(what)}"))
        .orderBy("month")
    )


def _class_series(
    classed: DataFrame, labels: list[str], scope: Scope
) -> DataFrame:
    # The labels are fixed, so one conditional sum each needs a single shuffle.
    spine = period_spine(classed.sparkSession, scope.start, scope.end, scope.freq)
    return with_spine(classed, spine).groupBy("period").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("class") == label, F.col("value"))), F.lit(0.0))
            .alias(label.replace(" ", "_"))
            for label in labels
        ]
    )


def material_mix_series(
    sales: DataFrame, scope: Scope, what: str = "income",
    words: Mapping[str, str] = schemas.MATERIAL_WORDS,
) -> DataFrame:
    """Measure per period in four columns by which of two words the description holds."""
    classed = scope.sales(sales).select(
        period_start("status_date", scope.freq).alias("period"),
        two_word_class(F.col("item_desc"), words).alias("class"),
        measure(what).alias("value"),
    )
    return _class_series(classed, two_word_labels(words), scope)


def color_mix_series(
    sales: DataFrame, scope: Scope, what: str = "income",
    words: Mapping[str, str] = schemas.COLOR_WORDS,
    many: str = schemas.MANY_COLORS, none: str = schemas.NO_COLOR,
) -> DataFrame:
    """Measure per period, one column per colour plus several and none."""
    classed = scope.sales(sales).select(
        period_start("status_date", scope.freq).alias("period"),
        single_word_class(F.col("item_desc"), words, many, none).alias("class"),
        measure(what).alias("value"),
    )
    return _class_series(classed, [*words, many, none], scope)


def color_totals(
    sales: DataFrame, scope: Scope, what: str = "income",
    words: Mapping[str, str] = schemas.COLOR_WORDS,
    many: str = schemas.MANY_COLORS, none: str = schemas.NO_COLOR,
) -> DataFrame:
    """Measure per colour class."""
    return (
        scope.sales(sales)
        .groupBy(single_word_class(F.col("item_desc"), words, many, none).alias("color"))
        .agg(F.coalesce(F.sum(measure(what)), F.lit(0.0)).alias(measure_name(what)))
        .orderBy("color")
    )


def qty_vs_income(sales: DataFrame, scope: Scope) -> DataFrame:
    """Quantity and income per period."""
    return calendar_fill(
        scope.sales(sales), "status_date", ["sales", "total_price"], scope.start, scope.end,
        scope.freq,
    )


def income_vs_expense(
    sales: DataFrame, supply_orders: DataFrame, scope: Scope,
    rates: Mapping[str, float] = schemas.HOME_RATES, unknown: str = "one",
    floor_date: str | None = None,
) -> DataFrame:
    """Income, converted supply spend and their difference per period, zero-filled.

    Both sides are stacked and summed together: one shuffle, no join of the two.
    """
    income = scope.sales(sales).select(
        F.to_date("status_date").alias("day"), F.col("total_price").cast("double").alias("total_price")
    )
    expense = scope.supply(supply_orders).select(
        F.to_date("date").alias("day"),
        home_currency(F.col("total_price"), F.col("coin"), rates, unknown)
        .alias("total_expense_ILS"),
    )
    rows = income.unionByName(expense, allowMissingColumns=True)
    if floor_date is not None:
        rows = rows.where(F.col("day") >= F.lit(floor_date).cast("date"))
    return calendar_fill(
        rows, "day", ["total_price", "total_expense_ILS"], scope.start, scope.end, scope.freq
    ).withColumn("diff", F.col("total_price") - F.col("total_expense_ILS"))


def total_income(sales: DataFrame, scope: Scope) -> DataFrame:
    """One total under all filters, 0 for no rows."""
    return scope.sales(sales).agg(
        F.coalesce(F.sum(F.col("total_price").cast("double")), F.lit(0.0)).alias("total_income")
    )


def _rolling(series: DataFrame, value: str, window_periods: int, statistic, name: str) -> DataFrame:
    # One row per calendar period, so the single window group is bounded by the date range.
    frame = Window.orderBy("period").rowsBetween(1 - window_periods, 0)
    return series.withColumn(
        name,
        F.when(F.count(value).over(frame) == window_periods, statistic(value).over(frame)),
    )


def rolling_variance(
    sales: DataFrame, scope: Scope, what: str = "income", window_periods: int = 7
) -> DataFrame:
    """Sample variance of the last ``window_periods`` period totals, NULL until they exist."""
    series = period_totals(sales, scope, what)
    return _rolling(series, measure_name(what), window_periods, F.var_samp, "price_variance")


def rolling_mean(
    sales: DataFrame, scope: Scope, what: str = "income", window_periods: int = 7
) -> DataFrame:
    """Moving average of the last ``window_periods`` period totals, NULL until they exist."""
    series = period_totals(sales, scope, what)
    return _rolling(series, measure_name(what), window_periods, F.avg, "moving_average")
