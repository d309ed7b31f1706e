"""Reports on supply orders and stock movements."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast import schemas
from shelfcast.functions.calendar import calendar_fill, period_spine, period_start, with_spine
from shelfcast.functions.filters import Scope
from shelfcast.operators.shared import home_currency, share_of_total


def supply_spend_by_status(
    supply_orders: DataFrame, scope: Scope, rates: Mapping[str, float] = schemas.HOME_RATES,
    unknown: str = "one",
) -> DataFrame:
    """Converted spend per order status."""
    spend = home_currency(F.col("total_price"), F.col("coin"), rates, unknown)
    return (
        scope.supply(supply_orders).groupBy("status")
        .agg(F.sum(spend).alias("total_expense_ILS"))
        .orderBy("status")
    )


def supply_spend_by_supplier(supply_orders: DataFrame, scope: Scope) -> DataFrame:
    """Stored spend per supplier with its percent of the total, descending."""
    totals = (
        scope.supply(supply_orders).groupBy("supply_name")
        .agg(F.sum(F.col("total_price_ILS").cast("double")).alias("total_price_ILS"))
    )
    return share_of_total(totals, "total_price_ILS").orderBy(
        F.desc("total_price_ILS"), "supply_name"
    )


def supply_spend_series(supply_orders: DataFrame, scope: Scope, digits: int = 2) -> DataFrame:
    """Stored spend per period, zero-filled and rounded half to even."""
    filled = calendar_fill(
        scope.supply(supply_orders), "date", ["total_price_ILS"], scope.start, scope.end, scope.freq
    )
    return filled.withColumn("total_price_ILS", F.bround("total_price_ILS", digits))


def stock_movement_series(stock_log: DataFrame, scope: Scope) -> DataFrame:
    """Quantity of the chosen movement types per period, zero-filled, signs as stored."""
    return calendar_fill(
        scope.stock(stock_log).withColumnRenamed("quantity", "total_quantity"),
        "update_date", ["total_quantity"], scope.start, scope.end, scope.freq,
    )


def net_outgoing(
    stock_log: DataFrame, scope: Scope,
    outgoing: Sequence[str] = tuple(schemas.OUTGOING_MOVEMENTS),
    returned: Sequence[str] = (schemas.MOVEMENT_RETURN,),
    keep_return_only: bool = False, digits: int = 2,
) -> DataFrame:
    """Outgoing minus returned quantity per period, zero-filled.

    A period with returns but nothing outgoing counts 0 unless ``keep_return_only``.
    """
    kind = F.col("inv_mov_type")
    amount = F.col("quantity").cast("double")
    rows = (
        scope.stock(stock_log).where(kind.isin([*outgoing, *returned]))
        .select(
            period_start("update_date", scope.freq).alias("period"),
            F.when(kind.isin(list(outgoing)), F.lit(1)).alias("is_out"),
            F.when(kind.isin(list(outgoing)), amount).alias("out"),
            F.when(kind.isin(list(returned)), amount).alias("back"),
        )
    )
    spine = period_spine(stock_log.sparkSession, scope.start, scope.end, scope.freq)
    net = F.coalesce(F.sum("out"), F.lit(0.0)) - F.coalesce(F.sum("back"), F.lit(0.0))
    if not keep_return_only:
        net = F.when(F.count("is_out") > 0, net).otherwise(0.0)
    return (
        with_spine(rows, spine).groupBy("period").agg(F.bround(net, digits).alias("net_quantity"))
    )
