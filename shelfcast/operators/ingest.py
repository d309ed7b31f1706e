"""Raw exports to clean, typed tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast import schemas
from shelfcast.functions.calendar import calendar_fill
from shelfcast.functions.cleaning import (
    clean_amount, decimal_number, normalize_dmy_date, normalize_item_code, parse_date_or_null,
)


def explode_order_items(
    orders: DataFrame, items: str = "ORDERITEMS_SUBFORM", key: str = "ORDNAME"
) -> DataFrame:
    """One row per order item with the parent's key; the parent's key wins over an item field
    of that name, and orders without items give no row."""
    rows = orders.select(F.col(key).alias("_parent"), F.explode(items).alias("_item"))
    fields = rows.schema["_item"].dataType.names
    return rows.select(
        *[F.col("_item").getField(f).alias(f) for f in fields if f != key],
        F.col("_parent").alias(key),
    )


def order_headers(orders: DataFrame, items: str = "ORDERITEMS_SUBFORM") -> DataFrame:
    """Orders without their nested items."""
    return orders.drop(items)


def conform_erp_lines(raw: DataFrame, headers: Mapping[str, str] = schemas.ERP_HEADERS) -> DataFrame:
    """Raw text export to the cleaned line table with the derived line amount."""
    named = raw.select(*[F.col(f"`{old}`").alias(new) for old, new in headers.items()])
    dates = ("date", "date_supply")
    amounts = (
        "quantity", "discount_percentage", "price_after_discount", "price_per_unit",
        "total_in_line",
    )
    cleaned = {
        **{c: parse_date_or_null(normalize_dmy_date(c), "dd/MM/yyyy") for c in dates},
        **{c: clean_amount(c) for c in amounts},
        "sku": normalize_item_code(F.col("sku"), named.schema["sku"].dataType),
    }
    return named.select(
        *[cleaned.get(c, F.col(c)).alias(c) for c in schemas.ERP_KEPT]
    ).withColumn("line_amount", F.col("price_after_discount") * F.col("quantity"))


def yearly_amount(
    df: DataFrame, start: str, end: str, date_column: str = "date", amount: str = "line_amount"
) -> DataFrame:
    """Amount per calendar year, years without rows 0."""
    return calendar_fill(df, date_column, [amount], start, end, "Y")


def unpivot_month_columns(
    feed: DataFrame, months: Mapping[str, str] = schemas.FEED_MONTHS
) -> DataFrame:
    """Month columns to rows ``(item, desc_he, date, quantity)``; rows without item are dropped,
    missing cells are 0 (a missing description becomes '0', as every cell is filled)."""
    filled = feed.where(F.col("item").isNotNull()).select(
        "item",
        F.coalesce(F.col("desc_he").cast("string"), F.lit("0")).alias("desc_he"),
        *[
            F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(day)
            for c, day in months.items()
        ],
    )
    long = filled.unpivot(["item", "desc_he"], list(months.values()), "date", "quantity")
    return long.withColumn("date", F.to_date("date"))


def representative_unit(stock_log: DataFrame) -> DataFrame:
    """First unit in sort order of every item."""
    return stock_log.groupBy("item").agg(F.min("unit").alias("unit"))


def with_representative_unit(feed: DataFrame, stock_log: DataFrame) -> DataFrame:
    """Feed rows with the unit of their item, NULL for unknown items."""
    codes = feed.withColumn("item", F.col("item").cast("string"))
    return codes.join(representative_unit(stock_log), "item", "left")


def conform_stock_log(feed: DataFrame, movement: str = schemas.MOVEMENT_FEED) -> DataFrame:
    """Monthly feed rows ``(item, desc_he, date, quantity, unit)`` in the stock log's layout."""
    costs = {"UCOST", "COST", "USECONDCOST", "SECONDCOST"}
    day = F.to_date("date")
    known = {
        "cur_date": day,
        "update_date": day,
        "inv_mov_type": F.lit(movement),
        "trans_id": F.lit("0"),
        **{c: F.col(c) for c in ("item", "desc_he", "quantity", "unit")},
        **{c: F.lit(0.0) for c in costs},
    }
    return feed.select(
        *[
            known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.STOCK_LOG.fields
        ]
    )


def conform_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to a fixed schema: absent columns are NULL, values that do not fit are NULL."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def fitted(field: T.StructField) -> Column:
        if field.name not in kinds:
            return F.lit(None).cast(field.dataType)
        column = F.col(f"`{field.name}`")
        if isinstance(kinds[field.name], T.StringType) and isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return decimal_number(column, field.dataType)
        return column.try_cast(field.dataType)

    return df.select(*[fitted(f).alias(f.name) for f in schema.fields])
