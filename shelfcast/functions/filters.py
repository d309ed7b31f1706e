"""Row predicates shared by the reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (start, length) of each part of the 8-character item code.
ITEM_PARTS = {"category": (0, 2), "catalog": (2, 3), "color": (5, 3), "catalog+color": (2, 6)}

# Column behind each measure.
MEASURES = {"income": "total_price", "sales": "sales"}


def in_filter(column: str, values: Sequence) -> Column:
    """``column IN values``; no values means no filter."""
    return F.col(column).isin(list(values)) if values else F.lit(True)


def code_part_filter(
    values: Sequence[str], start: int, length: int, column: str = "item"
) -> Column:
    """The ``length`` characters after position ``start`` (0-based) are one of ``values``.

    A leading part becomes ``startswith``, which Parquet row groups can be skipped by.
    """
    if not values:
        return F.lit(True)
    code = F.col(column)
    if start:
        return F.substring(code, start + 1, length).isin(list(values))
    found = F.lit(False)
    for value in values:
        if len(value) == length:
            found = found | code.startswith(value)
        elif len(value) < length:
            found = found | (code == value)
    return found


def item_dimension_filter(kind: str, values: Sequence[str], column: str = "item") -> Column:
    """Filter by a named part of the item code, or by the whole code."""
    if kind == "item":
        return in_filter(column, values)
    if kind not in ITEM_PARTS:
        raise ValueError(f"unknown item dimension {kind!r}")
    return code_part_filter(values, *ITEM_PARTS[kind], column=column)


def date_range_filter(column: str, start: str, end: str) -> Column:
    """Both ends inclusive, on the date part."""
    day = F.to_date(F.col(column))
    return day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def measure_name(measure: str) -> str:
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}")
    return MEASURES[measure]


def measure(name: str) -> Column:
    """Column of a measure: ``income`` or ``sales``."""
    return F.col(measure_name(name)).cast("double")


@dataclass(frozen=True)
class Scope:
    """Date range, period length and filters of one report run."""

    start: str
    end: str
    freq: str = "W"
    order_status: tuple[str, ...] = ()
    units: tuple[str, ...] = ()
    item_kind: str = "item"
    item_values: tuple[str, ...] = ()
    movements: tuple[str, ...] = ()
    supply_status: tuple[str, ...] = ()

    def sales(self, sales: DataFrame) -> DataFrame:
        return sales.where(
            date_range_filter("status_date", self.start, self.end)
            & in_filter("order_status", self.order_status)
            & in_filter("unit", self.units)
            & item_dimension_filter(self.item_kind, self.item_values)
        )

    def orders(self, orders: DataFrame) -> DataFrame:
        return orders.where(
            date_range_filter("status_date", self.start, self.end)
            & in_filter("order_status", self.order_status)
        )

    def supply(self, supply_orders: DataFrame) -> DataFrame:
        return supply_orders.where(
            date_range_filter("date", self.start, self.end)
            & in_filter("status", self.supply_status)
        )

    def stock(self, stock_log: DataFrame, date_column: str = "update_date") -> DataFrame:
        return stock_log.where(
            date_range_filter(date_column, self.start, self.end)
            & in_filter("inv_mov_type", self.movements)
            & in_filter("unit", self.units)
            & item_dimension_filter(self.item_kind, self.item_values)
        )
