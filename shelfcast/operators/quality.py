"""Data quality checks and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.calendar import period_start
from shelfcast.operators.order_reports import binned_counts
from shelfcast.operators.shared import top_items

#: A sketch's ranks are wrong by at most one in so many rows; brackets are wider by MARGIN.
SKETCH_ACCURACY = 10_000
MARGIN = 4 / SKETCH_ACCURACY


def _numeric_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) for every non-missing value of the listed columns."""
    long = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value"
    )
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _described_quantiles(rows: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(column, moments, probability, quantile) of (column, value) rows, in two passes.

    The first gives each column's moments and, from a sketch of bounded size, a bracket around every
    wanted quantile. The second counts what lies below a bracket as one number and what lies inside
    value by value. A bracket holds the same small share of the rows whatever the distribution, so
    outliers don't widen it. Both passes pre-aggregate; what is broadcast has a row per column.
    """
    points = [min(max(p + side, 0.0), 1.0) for p in probabilities for side in (-MARGIN, MARGIN)]
    known = rows.groupBy("column").agg(
        F.struct(
            F.count("value").alias("count"), F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        ).alias("moments"),
        F.percentile_approx("value", points, SKETCH_ACCURACY).alias("cuts"),
    )
    brackets = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("probability"), F.get("cuts", F.lit(2 * i)).alias("low"),
                F.get("cuts", F.lit(2 * i + 1)).alias("high"),
            )
            for i, p in enumerate(probabilities)
        ]
    )
    near = rows.join(F.broadcast(known.select("column", "moments", brackets.alias("brackets"))), "column").select(
        "column", "moments", "value", F.explode(F.filter("brackets", lambda b: F.col("value") <= b["high"])).alias("b")
    )
    inside = F.when(F.col("value") >= F.col("b.low"), F.col("value"))
    counts = near.groupBy("column", "moments", "b.probability", inside.alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # null, the rows below the bracket, comes first
    order = Window.partitionBy("column", "probability").orderBy(F.asc_nulls_first("value"))
    spans = counts.withColumn("upto", F.sum("n").over(order))
    position = F.col("probability") * (F.col("moments.count") - 1)

    def at(rank: Column) -> Column:
        here = (rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto"))
        return F.max(F.when(here, F.col("value")))

    found = spans.groupBy("column", "moments", "probability").agg(
        at(F.floor(position)).alias("below"), at(F.ceil(position)).alias("above")
    )
    missed = F.raise_error(F.concat(F.lit("no quantile found for column "), F.col("column"))).cast("double")
    quantile = F.col("below") + (F.col("above") - F.col("below")) * (position - F.floor(position))
    return found.select("column", "moments", "probability", F.coalesce(quantile, missed).alias("quantile"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, as ``(column, probability, quantile)``."""
    return _described_quantiles(_numeric_rows(df, columns), probabilities).drop("moments")


def profile_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of numeric columns."""
    names = {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    quartiles = [
        F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(name) for p, name in names.items()
    ]
    found = _described_quantiles(_numeric_rows(df, columns), list(names))
    return found.groupBy("column", "moments").agg(*quartiles).select(
        "column", "moments.count", "moments.mean", "moments.std", "moments.min", *names.values(), "moments.max"
    )


def schema_and_nulls(df: DataFrame) -> DataFrame:
    """Position, type, non-null and null count of every column; one pass over the data."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.col(f"`{f.name}`")).alias(f"_n{i}") for i, f in enumerate(df.schema.fields)],
    )
    lines = [
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"), F.col(f"_n{i}").alias("non_null"),
            (F.col("_rows") - F.col(f"_n{i}")).alias("nulls"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counted.select(F.explode(F.array(*lines)).alias("_line")).select("_line.*")


def _differs(left: str, right: str) -> Column:
    a, b = F.col(left), F.col(right)
    return a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b) | (a != b)


def line_total_mismatch(df: DataFrame, total: str, product: str) -> DataFrame:
    """Rows whose stated total is not the product; a missing side is a mismatch."""
    return df.where(_differs(total, product))


def line_total_summary(df: DataFrame, total: str, product: str) -> DataFrame:
    """How many rows mismatch and how many agree."""
    return df.agg(
        F.count_if(_differs(total, product)).alias("mismatched"),
        F.count_if(~_differs(total, product)).alias("matched"),
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values per column and the row count."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_distinct(c).alias(f"distinct_{c}") for c in columns],
    )


def topn_by_count(
    df: DataFrame, key: str, value: str = "quantity", n: int = 50, by_sum: bool = False
) -> DataFrame:
    """The ``n`` keys with the most non-null values (or the largest sum)."""
    score = F.sum(value) if by_sum else F.count(value)
    totals = df.groupBy(key).agg(score.alias(f"{'sum' if by_sum else 'count'}_{value}"))
    return top_items(totals, key, totals.columns[-1], n)


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per non-null value, most frequent first."""
    return (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), key)
    )


def histogram(df: DataFrame, column: str, start: float, stop: float, step: float) -> DataFrame:
    """Counts on edges ``start, start + step, ...``; the last bin includes ``stop``."""
    bins = round((stop - start) / step)
    return binned_counts(df, F.col(column).cast("double"), start, step, bins)


def equal_bin_histogram(df: DataFrame, column: str, bins: int = 2000) -> DataFrame:
    """Counts in equal bins between the column's minimum and maximum."""
    value = F.col(column).cast("double")
    present = df.select(value.alias("value")).where(value.isNotNull() & ~F.isnan(value))
    low, high = (present.agg(f("value")).scalar() for f in (F.min, F.max))
    spread = F.when(high > low, F.lit(0.0)).otherwise(F.lit(0.5))
    low, high = low - spread, high + spread
    counts = present.groupBy(
        F.least(F.floor((F.col("value") - low) * F.lit(float(bins)) / (high - low)), F.lit(bins - 1))
        .cast("int").alias("bin")
    ).agg(F.count(F.lit(1)).alias("count"))
    edges = df.sparkSession.range(0, bins, 1, 1).select(
        F.col("id").cast("int").alias("bin"),
        (low + F.col("id") * (high - low) / F.lit(float(bins))).alias("bin_start"),
    )
    return (
        edges.join(counts, "bin", "left")
        .select("bin", "bin_start", F.coalesce("count", F.lit(0)).alias("count")).orderBy("bin")
    )


def monthly_amount(df: DataFrame, date_column: str = "date", amount: str = "line_amount") -> DataFrame:
    """Amount per month that has rows."""
    return (
        df.groupBy(period_start(date_column, "M").alias("month"))
        .agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias(amount)).orderBy("month")
    )


def yearly_split(
    df: DataFrame, sku: str, freq: str = "Y", date_column: str = "date", key: str = "sku",
    amount: str = "line_amount",
) -> DataFrame:
    """Amount per period of one SKU against all other rows, in one pass.

    Rows without SKU count as other.
    """
    own = F.coalesce(F.col(key) == sku, F.lit(False))
    return (
        df.groupBy(period_start(date_column, freq).alias("period"))
        .agg(
            F.coalesce(F.sum(F.when(own, F.col(amount))), F.lit(0.0)).alias("own_amount"),
            F.coalesce(F.sum(F.when(~own, F.col(amount))), F.lit(0.0)).alias("other_amount"),
        )
        .orderBy("period")
    )


def rows_by_description(
    df: DataFrame, sku: str, word: str, contains: bool = True, key: str = "sku",
    description: str = "description_sku",
) -> DataFrame:
    """Rows of one SKU whose description does (or does not) hold a word; NULL is in neither."""
    holds = F.col(description).contains(word)
    return df.where((F.col(key) == sku) & (holds if contains else ~holds))


def descriptions_of_sku(
    df: DataFrame, sku: str, word: str, value: str = "quantity", key: str = "sku",
    description: str = "description_sku", n: int = 50,
) -> DataFrame:
    """The most frequent descriptions of one SKU and whether they hold a word."""
    return topn_by_count(df.where(F.col(key) == sku), description, value, n).withColumn(
        "has_word", F.col(description).contains(word)
    )


def positive_item_totals(df: DataFrame, key: str = "item", value: str = "sales") -> DataFrame:
    """Totals per item above 0, ascending."""
    return (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).alias(value))
        .where(F.col(value) > 0).orderBy(value, key)
    )


def seasonal_totals(
    df: DataFrame, unit: str = "month", date_text: str = "date", value: str = "sales"
) -> DataFrame:
    """Totals per month of year or per year of a ``YYYY-MM...`` text."""
    part = {"year": 0, "month": 1}[unit]
    return (
        df.groupBy(F.get(F.split(date_text, "-"), F.lit(part)).alias(unit))
        .agg(F.sum(value).alias(value)).orderBy(unit)
    )


def top_item_series(
    df: DataFrame, k: int = 10, key: str = "item", value: str = "sales", ascending: bool = False
) -> DataFrame:
    """All rows of the ``k`` items with the largest (or smallest) positive totals."""
    totals = df.groupBy(key).agg(F.sum(value).alias("_total")).where(F.col("_total") > 0)
    best = top_items(totals, key, "_total", k, ascending)
    return df.join(F.broadcast(best.select(key)), key, "left_semi")


def null_measure_items(df: DataFrame, value: str, key: str = "item") -> DataFrame:
    """Distinct items that have a row with a missing measure."""
    return df.where(F.col(value).isNull()).select(key).distinct()


def rows_by_presence(df: DataFrame, column: str, present: bool) -> DataFrame:
    """Rows where a column is set, or is not."""
    return df.where(F.col(column).isNotNull() if present else F.col(column).isNull())
