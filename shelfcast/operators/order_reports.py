"""Reports on orders and customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.calendar import period_spine, period_start, with_spine
from shelfcast.functions.filters import Scope


def numbered_bins(value: Column, start: float, step: float, bins: int) -> Column:
    """0-based bin of ``value`` on equal edges, the last bin closed, NULL outside."""
    stop = start + step * bins
    inside = value.between(F.lit(float(start)), F.lit(float(stop)))
    index = F.least(F.floor((value - F.lit(float(start))) / F.lit(float(step))), F.lit(bins - 1))
    return F.when(inside, index.cast("int"))


def binned_counts(df: DataFrame, value: Column, start: float, step: float, bins: int) -> DataFrame:
    """Count per bin, empty bins 0."""
    rows = df.select(numbered_bins(value, start, step, bins).alias("bin"), F.lit(1).alias("hit"))
    spine = df.sparkSession.range(0, bins, 1, 1).select(F.col("id").cast("int").alias("bin"))
    return (
        with_spine(rows.where(F.col("bin").isNotNull()), spine)
        .groupBy("bin").agg(F.count("hit").alias("count"))
        .select(
            (F.lit(float(start)) + F.col("bin") * F.lit(float(step))).alias("bin_start"),
            (F.lit(float(start)) + (F.col("bin") + 1) * F.lit(float(step))).alias("bin_end"),
            "count",
        )
        .orderBy("bin_start")
    )


def order_value_histogram(
    orders: DataFrame, scope: Scope, start: float = 0.0, stop: float = 2490.0, step: float = 10.0
) -> DataFrame:
    """Orders per value bin; values outside the edges are not counted."""
    value = F.col("total_price_with_discount").cast("double")
    return binned_counts(scope.orders(orders), value, start, step, round((stop - start) / step))


def _by_customer_attribute(
    orders: DataFrame, customers: DataFrame, scope: Scope, attribute: str
) -> DataFrame:
    # Orders shrink to one row per customer before the join, so a customer with very many
    # orders is one row in it; one row per customer on the other side keeps totals from
    # multiplying when a customer is listed twice.
    per_customer = (
        scope.orders(orders).groupBy("cust_id")
        .agg(F.sum(F.col("total_price_with_discount").cast("double")).alias("amount"))
    )
    one_each = customers.groupBy("cust_id").agg(F.min(attribute).alias(attribute))
    return (
        per_customer.join(one_each, "cust_id", "left")
        .groupBy(attribute).agg(F.sum("amount").alias("total_price_with_discount"))
    )


def income_by_country(orders: DataFrame, customers: DataFrame, scope: Scope) -> DataFrame:
    """Order income per customer country, descending; unmatched customers are the NULL group."""
    return (
        _by_customer_attribute(orders, customers, scope, "country")
        .withColumnRenamed("country", "cust_country")
        .orderBy(F.desc("total_price_with_discount"), "cust_country")
    )


def income_by_state(
    orders: DataFrame, customers: DataFrame, scope: Scope, reverse_label: bool = False
) -> DataFrame:
    """Order income per customer state with its display label."""
    totals = _by_customer_attribute(orders, customers, scope, "state")
    shown = F.reverse("cust_city") if reverse_label else F.col("cust_city")
    return (
        totals.withColumnRenamed("state", "cust_city")
        .withColumn("label", F.format_string("%s - %.2f ILS", shown, "total_price_with_discount"))
        .orderBy(F.desc("total_price_with_discount"), "cust_city")
    )


def orders_per_day(orders: DataFrame, scope: Scope) -> DataFrame:
    """Orders per day, zero-filled."""
    rows = scope.orders(orders).select(F.to_date("status_date").alias("status_date"), "order_id")
    spine = period_spine(orders.sparkSession, scope.start, scope.end, "D", "status_date")
    return (
        with_spine(rows, spine).groupBy("status_date")
        .agg(F.count("order_id").alias("order_count"))
    )


def unique_customers_series(orders: DataFrame, scope: Scope) -> DataFrame:
    """Distinct customers per period, zero-filled; counted once per final period."""
    rows = scope.orders(orders).select(
        period_start("status_date", scope.freq).alias("period"), "cust_id"
    )
    spine = period_spine(orders.sparkSession, scope.start, scope.end, scope.freq)
    return (
        with_spine(rows, spine).groupBy("period")
        .agg(F.count_distinct("cust_id").alias("unique_customers"))
    )


def unique_customers_rollup(orders: DataFrame, scope: Scope, freqs: str = "DWMQY") -> DataFrame:
    """Distinct customers of every period with orders, for several frequencies in one pass:
    (freq, period, unique_customers).

    Distinct counts can't be added up, but sets can: each day's customers become bitmaps, one per
    bucket of 32,768 customer numbers, and a longer period's bitmap is the union of its days'. Raw
    rows are read and aggregated once; behind that only bitmaps move. Customer numbers have to be
    whole numbers; null ones don't count.
    """
    customer = F.col("cust_id").cast("long")
    daily = (
        scope.orders(orders).where(customer.isNotNull())
        .groupBy(F.to_date("status_date").alias("day"), F.bitmap_bucket_number(customer).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(customer)).alias("bits"))
    )
    periods = F.array(
        *[F.struct(F.lit(f).alias("freq"), period_start("day", f).cast("date").alias("period")) for f in freqs]
    )
    united = (
        daily.select("bucket", "bits", F.inline(periods))
        .groupBy("freq", "period", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    )
    return united.groupBy("freq", "period").agg(F.sum("n").alias("unique_customers"))
