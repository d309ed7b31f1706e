"""Every operator as a query over the supplied tables.

A query runs over whole tables. Results are shown with doubles rounded and dates as ISO text, so
that two engines print the same value for the same number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast import schemas
from shelfcast.functions import calendar, cleaning
from shelfcast.functions import filters as flt
from shelfcast.functions.filters import Scope
from shelfcast.operators import (
    autoregression, backtest, ingest, order_reports, panel, quality, sales_reports, supply_reports,
    tuning,
)
from shelfcast.operators.shared import share_of_total
from shelfcast.plans import tables
from shelfcast.session import scratch_path
from shelfcast.sources import readers, stored, writers

Query = Callable[[SparkSession, str], DataFrame]

START, END = "1995-01-01", "2001-12-31"
CHECK_START, CHECK_END = "2000-12-01", "2001-11-30"
TARGET = "2002-04-30"
TEST_START = "2001-01-01"
CATEGORY_IDS = [f"{brand:02d}_category" for brand in range(1, 26)]
SKU = "7"

WEEKLY = Scope(START, END, "W")
MONTHLY = Scope(START, END, "M")
DAILY = Scope(START, END, "D")

_QUERIES: dict[str, Query] = {}


def present(df: DataFrame, digits: int = 4) -> DataFrame:
    shown = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            column = F.round(column, digits)
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        shown.append(column.alias(field.name))
    return df.select(*shown)


def query(run: Query, name: str | None = None, digits: int = 4) -> Query:
    """Register a function, under its own name unless another is given."""
    _QUERIES[name or run.__name__] = lambda spark, sf_dir: present(run(spark, sf_dir), digits)
    return run


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# ---------------------------------------------------------------- ingestion and cleaning


def _text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _described(lines: DataFrame) -> DataFrame:
    return lines.groupBy("description_sku", "delivery_type").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(cleaning.clean_amount("price_after_discount")).alias("price"),
        F.sum(cleaning.clean_amount("quantity")).alias("quantity"),
    )


@query
def load_delimited(spark, sf_dir):
    path = scratch_path(spark, "erp-csv")
    writers.write_csv(tables.erp_text(spark, sf_dir), path)
    raw = readers.load_delimited(spark, path, _text_schema(list(schemas.ERP_HEADERS)))
    return _described(raw.withColumnsRenamed(schemas.ERP_HEADERS))


@query
def write_csv(spark, sf_dir):
    path = scratch_path(spark, "totals-csv")
    writers.write_csv(
        sales_reports.period_totals(tables.sales(spark, sf_dir), MONTHLY, "sales"), path
    )
    return readers.load_delimited(spark, path, T.StructType.fromDDL("period date, sales double"))


@query
def load_json_envelope(spark, sf_dir):
    path = scratch_path(spark, "envelopes")
    lines = tables.inventory_text(spark, sf_dir)
    # the lines of a document in one envelope: several elements, and never more than it has lines
    lines.groupBy("DOC").agg(F.collect_list(F.struct(*lines.columns)).alias("value")).select(
        F.to_json(F.struct("value")).alias("value")
    ).write.text(path)
    schema = _text_schema(["DOC", "KLINE", "TQUANT", "COST", "TYPE"])
    return readers.load_json_envelope(spark, path, schema, multi_line=False)


@query
def load_pretty_envelope(spark, sf_dir):
    """Envelopes printed over many lines, read by byte ranges."""
    path = scratch_path(spark, "pretty-envelopes")
    lines = tables.inventory_text(spark, sf_dir)
    tables.pretty_envelopes(lines, 4).write.partitionBy("part").text(path)
    schema = _text_schema(lines.columns)
    return readers.load_pretty_envelope(spark, f"{path}/part=*", schema)


@query
def explode_order_items(spark, sf_dir):
    return ingest.explode_order_items(tables.order_documents(spark, sf_dir))


@query
def order_headers(spark, sf_dir):
    return ingest.order_headers(tables.order_documents(spark, sf_dir))


@query
def normalize_null_tokens(spark, sf_dir):
    return cleaning.normalize_null_tokens(tables.inventory_text(spark, sf_dir))


@query
def coerce_numeric(spark, sf_dir):
    return cleaning.coerce_numeric(tables.inventory_text(spark, sf_dir), ["TQUANT", "COST"])


def _raw_dates(spark, sf_dir):
    day = F.to_date("l_shipdate")
    line = F.col("l_linenumber") % 5
    raw = (
        F.when(line == 0, F.date_format(day, "d/M/yy"))
        .when(line == 1, F.concat(F.date_format(day, "d/M/"), F.substring(F.date_format(day, "yyyy"), 2, 3)))
        .when(line == 2, F.date_format(day, "MM/dd/yyyy"))
        .when(line == 3, F.date_format(day, "d-M-yyyy"))
    )
    return tables.read(spark, sf_dir, "lineitem").select(raw.alias("raw"))


@query
def normalize_dmy_date(spark, sf_dir):
    return (
        _raw_dates(spark, sf_dir).groupBy("raw").agg(F.count(F.lit(1)).alias("lines"))
        .withColumn("normalized", cleaning.normalize_dmy_date("raw"))
    )


@query
def parse_date_or_null(spark, sf_dir):
    return (
        _raw_dates(spark, sf_dir).groupBy("raw").agg(F.count(F.lit(1)).alias("lines"))
        .select(
            "raw", "lines", cleaning.parse_date_or_null("raw", "d/M/yyyy").alias("parsed"),
            cleaning.reformat_date("raw", "d/M/yyyy").alias("dashed"),
            cleaning.reformat_date("raw", "d-M-yyyy").alias("from_dashes"),
        )
    )


@query
def normalize_item_code(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    form = F.col("p_size") % 6
    raw = (
        F.when(form == 0, F.lpad(key, 10, "0")).when(form == 1, F.concat(F.lit(" +"), key))
        .when(form == 2, F.concat(key, F.lit(".0"))).when(form == 3, F.concat(F.lit("A-"), key))
        .when(form == 4, F.concat(F.lit("-0"), key))
    )
    return tables.read(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).select(
        "p_partkey", cleaning.normalize_item_code(F.col("raw")).alias("sku")
    )


@query
def clean_amount(spark, sf_dir):
    raw = tables.erp_text(spark, sf_dir).withColumnsRenamed(schemas.ERP_HEADERS)
    return raw.groupBy("price_after_discount", "discount_percentage").agg(
        F.count(F.lit(1)).alias("lines")
    ).select(
        cleaning.clean_amount("price_after_discount").alias("price"),
        cleaning.clean_amount("discount_percentage").alias("discount"), "lines",
    )


def _erp_lines(spark, sf_dir):
    return ingest.conform_erp_lines(tables.erp_text(spark, sf_dir))


@query
def conform_erp_lines(spark, sf_dir):
    return _erp_lines(spark, sf_dir)


@query
def yearly_amount(spark, sf_dir):
    return ingest.yearly_amount(_erp_lines(spark, sf_dir), START, "2003-12-31")


@query
def unpivot_month_columns(spark, sf_dir):
    return ingest.unpivot_month_columns(
        tables.monthly_feed(spark, sf_dir), tables.month_columns()
    )


@query
def representative_unit(spark, sf_dir):
    return ingest.representative_unit(tables.stock_log(spark, sf_dir))


@query
def conform_stock_log(spark, sf_dir):
    feed = ingest.unpivot_month_columns(
        tables.monthly_feed(spark, sf_dir), tables.month_columns()
    )
    return ingest.conform_stock_log(
        ingest.with_representative_unit(feed, tables.stock_log(spark, sf_dir))
    )


@query
def append_table(spark, sf_dir):
    path = scratch_path(spark, "stock")
    rows = tables.stock_log(spark, sf_dir)
    writers.append_table(rows, path, ["inv_mov_type"])
    # a repeated run of one movement type replaces its partition instead of doubling it
    writers.append_table(
        rows.where(F.col("inv_mov_type") == "return"), path, ["inv_mov_type"],
        "overwrite_partitions",
    )
    writers.append_table(rows.where(F.col("inv_mov_type") == "invoice"), path, ["inv_mov_type"])
    return spark.read.schema(rows.schema).parquet(path).groupBy("inv_mov_type", "unit").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("quantity")
    )


@query
def filter_and_publish(spark, sf_dir):
    path = scratch_path(spark, "published")
    writers.filter_and_publish(_panel(spark, sf_dir), path, CATEGORY_IDS)
    return spark.read.schema(schemas.PANEL).parquet(path)


@query
def append_once(spark, sf_dir):
    """Two tries of one run and another run over some of the same rows leave each row once."""
    path = scratch_path(spark, "stock-once")
    rows = tables.stock_log(spark, sf_dir)
    keys = ["inv_mov_type", "item"]
    deliveries = rows.where(F.col("inv_mov_type") == "delivery")
    # a first try that was stopped on its way
    writers.append_once(deliveries.where(F.col("quantity") < 20), path, "first", keys)
    writers.append_once(deliveries, path, "first", keys)
    writers.append_once(rows, path, "second", keys)
    written = spark.read.schema(rows.schema).parquet(path)
    return written.groupBy("inv_mov_type", "unit").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("quantity")
    )


@query
def publish_once(spark, sf_dir):
    path = scratch_path(spark, "published-once")
    rows = _panel(spark, sf_dir)
    writers.filter_and_publish(rows, path, CATEGORY_IDS[:15], run="first")
    writers.filter_and_publish(rows, path, CATEGORY_IDS[:15], run="first")
    writers.filter_and_publish(rows, path, CATEGORY_IDS, run="second")
    return spark.read.schema(schemas.PANEL).parquet(path).select(schemas.PANEL.names)


@query
def load_delimited_rescued(spark, sf_dir):
    """Lines with a number that is none, or with a field too many, go to a table of their own."""
    path, good, bad = (scratch_path(spark, f"rescued-{name}") for name in ("csv", "good", "bad"))
    line = F.col("l_linenumber")
    quantity = F.when(line == 7, F.lit("many")).otherwise(F.col("l_quantity").cast("string"))
    tail = F.when(line == 6, F.lit(",surplus")).otherwise(F.lit(""))
    tables.read(spark, sf_dir, "lineitem").select(
        F.concat(F.concat_ws(",", F.col("l_orderkey"), line, quantity), tail).alias("value")
    ).write.text(path)
    schema = T.StructType.fromDDL("order_id long, line int, quantity double")
    # part files have no header line of their own
    rows = readers.load_delimited(spark, path, schema, rescued=True, header=False)
    writers.quarantine(rows, good, bad)
    kept = spark.read.schema(schema).parquet(good).select(F.lit("fits").alias("kind"), "quantity")
    lost = spark.read.schema(f"{readers.RESCUED} string, {readers.SOURCE} string").parquet(bad).select(
        F.when(F.col(readers.RESCUED).endswith(",surplus"), "a field too many").otherwise("not a number").alias("kind"),
        F.lit(None).cast("double").alias("quantity"),
    )
    return kept.union(lost).groupBy("kind").agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("quantity"))


# ---------------------------------------------------------------- filters and dimensions


def _status_sums(sales: DataFrame, *keys: str) -> DataFrame:
    return sales.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("sales").alias("sales")
    )


@query
def in_filter(spark, sf_dir):
    sales = tables.sales(spark, sf_dir, with_item=False)
    kept = sales.where(flt.in_filter("order_status", ["F", "O"]) & flt.in_filter("sales", []))
    return _status_sums(kept, "order_status")


@query
def code_part_filter(spark, sf_dir):
    sales = tables.sales(spark, sf_dir)
    kept = sales.where(
        flt.code_part_filter(["000", "001", "009"], 2, 3)
        & flt.code_part_filter(["01", "02", "11", "25"], 0, 2)
    )
    return _status_sums(kept, "item")


@query
def item_dimension_filter(spark, sf_dir):
    sales = tables.sales(spark, sf_dir)
    kept = sales.where(
        flt.item_dimension_filter("category", ["03", "17"])
        | flt.item_dimension_filter("color", ["007", "00K"])
    )
    return _status_sums(kept, "item", "unit")


@query
def date_range_filter(spark, sf_dir):
    orders = tables.read(spark, sf_dir, "orders")
    kept = orders.where(flt.date_range_filter("o_orderdate", "1996-02-29", "1999-12-31"))
    return kept.groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("orders")
    )


@query
def measure(spark, sf_dir):
    return tables.sales(spark, sf_dir, with_item=False).groupBy("order_status").agg(
        F.sum(flt.measure("income")).alias("income"), F.sum(flt.measure("sales")).alias("sales")
    )


@query
def period_start(spark, sf_dir):
    days = tables.read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    return days.select(
        "day", "orders",
        *[calendar.period_start("day", f).alias(f"start_{f}") for f in "DWMQY"],
        calendar.period_start("day", "W", "end").alias("end_W"),
    )


@query
def period_label(spark, sf_dir):
    days = tables.read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    return days.select(
        "day", "orders",
        *[
            calendar.period_label(calendar.period_start("day", f), f).alias(f"label_{f}")
            for f in "WMY"
        ],
    )


@query
def calendar_fill(spark, sf_dir):
    return calendar.calendar_fill(
        tables.sales(spark, sf_dir), "status_date", ["sales", "total_price"], START, END, "W",
        keys=["unit"],
    )


# ---------------------------------------------------------------- reports


@query
def period_totals(spark, sf_dir):
    return sales_reports.period_totals(tables.sales(spark, sf_dir, with_item=False), WEEKLY)


@query
def topk_item_series(spark, sf_dir):
    return sales_reports.topk_item_series(tables.sales(spark, sf_dir), WEEKLY)


@query
def topk_and_others(spark, sf_dir):
    return share_of_total(
        sales_reports.topk_and_others(tables.sales(spark, sf_dir), WEEKLY), "total_price"
    )


@query
def avg_by_weekday(spark, sf_dir):
    return sales_reports.avg_by_weekday(tables.sales(spark, sf_dir, with_item=False), WEEKLY)


@query
def avg_by_day_of_month(spark, sf_dir):
    return sales_reports.avg_by_day_of_month(tables.sales(spark, sf_dir, with_item=False), WEEKLY)


@query
def avg_by_month(spark, sf_dir):
    return sales_reports.avg_by_month(tables.sales(spark, sf_dir, with_item=False), WEEKLY)


@query
def material_mix_series(spark, sf_dir):
    return sales_reports.material_mix_series(
        tables.sales(spark, sf_dir), WEEKLY, words=tables.MATERIALS
    )


@query
def color_mix_series(spark, sf_dir):
    return sales_reports.color_mix_series(
        tables.sales(spark, sf_dir), WEEKLY, words=tables.COLORS
    )


@query
def color_totals(spark, sf_dir):
    return sales_reports.color_totals(tables.sales(spark, sf_dir), WEEKLY, words=tables.COLORS)


@query
def qty_vs_income(spark, sf_dir):
    return sales_reports.qty_vs_income(tables.sales(spark, sf_dir, with_item=False), WEEKLY)


@query
def supply_spend_by_status(spark, sf_dir):
    return supply_reports.supply_spend_by_status(tables.supply_orders(spark, sf_dir), WEEKLY)


@query
def income_vs_expense(spark, sf_dir):
    return sales_reports.income_vs_expense(
        tables.sales(spark, sf_dir, with_item=False), tables.supply_orders(spark, sf_dir), WEEKLY
    )


@query
def order_value_histogram(spark, sf_dir):
    return order_reports.order_value_histogram(
        tables.orders(spark, sf_dir), WEEKLY, 0.0, 498000.0, 2000.0
    )


@query
def income_by_country(spark, sf_dir):
    return order_reports.income_by_country(
        tables.orders(spark, sf_dir), tables.customers(spark, sf_dir), WEEKLY
    )


@query
def orders_per_day(spark, sf_dir):
    return order_reports.orders_per_day(tables.orders(spark, sf_dir), WEEKLY)


@query
def rolling_variance(spark, sf_dir):
    rolled = sales_reports.rolling_variance(tables.sales(spark, sf_dir, with_item=False), WEEKLY)
    # variances of money sums are of order 1e12: print them to the thousand
    return rolled.withColumn("price_variance", F.round("price_variance", -3))


@query
def rolling_mean(spark, sf_dir):
    return sales_reports.rolling_mean(tables.sales(spark, sf_dir, with_item=False), WEEKLY)


@query
def stock_movement_series(spark, sf_dir):
    scope = Scope(START, END, "W", movements=("return", "invoice"))
    return supply_reports.stock_movement_series(tables.stock_log(spark, sf_dir), scope)


@query
def net_outgoing(spark, sf_dir):
    return supply_reports.net_outgoing(
        tables.stock_log(spark, sf_dir), WEEKLY, ("delivery", "invoice"), ("return",)
    )


@query
def supply_spend_by_supplier(spark, sf_dir):
    return supply_reports.supply_spend_by_supplier(tables.supply_orders(spark, sf_dir), WEEKLY)


@query
def supply_spend_series(spark, sf_dir):
    return supply_reports.supply_spend_series(tables.supply_orders(spark, sf_dir), WEEKLY, 0)


@query
def income_by_state(spark, sf_dir):
    return order_reports.income_by_state(
        tables.orders(spark, sf_dir), tables.customers(spark, sf_dir), WEEKLY
    )


@query
def unique_customers_series(spark, sf_dir):
    return order_reports.unique_customers_series(tables.orders(spark, sf_dir), WEEKLY)


@query
def unique_customers_rollup(spark, sf_dir):
    return order_reports.unique_customers_rollup(tables.orders(spark, sf_dir), DAILY)


@query
def total_income(spark, sf_dir):
    return sales_reports.total_income(tables.sales(spark, sf_dir, with_item=False), WEEKLY)


def _unit_shares(spark, sf_dir):
    units = tables.sales(spark, sf_dir).groupBy("unit", "order_status").agg(
        F.sum("total_price").alias("total_price")
    )
    return share_of_total(units, "total_price")


query(_unit_shares, "share_of_total")


# ---------------------------------------------------------------- the same with every filter set

CATEGORIES = ("03", "08", "17", "21")
SCOPED = Scope(
    "1996-02-29", "2000-10-31", "W", order_status=("F", "P"), units=tables.UNITS,
    item_kind="category", item_values=CATEGORIES, movements=("delivery", "return"), supply_status=("F",),
)


@query
def period_totals_scoped(spark, sf_dir):
    return sales_reports.period_totals(tables.sales(spark, sf_dir), SCOPED, "sales")


@query
def period_totals_week_end(spark, sf_dir):
    return sales_reports.period_totals(
        tables.sales(spark, sf_dir, with_item=False), WEEKLY, "sales", week_label="end"
    )


@query
def net_outgoing_scoped(spark, sf_dir):
    return supply_reports.net_outgoing(
        tables.stock_log(spark, sf_dir), SCOPED, ("delivery",), ("return",), keep_return_only=True
    )


@query
def supply_spend_scoped(spark, sf_dir):
    """Spend of known currencies only, of one status."""
    orders = tables.supply_orders(spark, sf_dir).withColumn(
        "coin", F.when(F.col("coin") == "EUR", "XXX").otherwise(F.col("coin"))
    )
    return supply_reports.supply_spend_by_status(orders, SCOPED, unknown="null")


# ---------------------------------------------------------------- data quality


@query
def profile_columns(spark, sf_dir):
    return quality.profile_columns(
        tables.read(spark, sf_dir, "lineitem"),
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    )


@query
def schema_and_nulls(spark, sf_dir):
    return quality.schema_and_nulls(
        cleaning.normalize_null_tokens(tables.inventory_text(spark, sf_dir))
    )


@query
def line_total_mismatch(spark, sf_dir):
    rows = quality.line_total_mismatch(
        _erp_lines(spark, sf_dir), "total_in_line", "line_amount"
    )
    return rows.select("date", "sku", "total_in_line", "line_amount")


@query
def line_total_summary(spark, sf_dir):
    return quality.line_total_summary(_erp_lines(spark, sf_dir), "total_in_line", "line_amount")


@query
def distinct_counts(spark, sf_dir):
    return quality.distinct_counts(_erp_lines(spark, sf_dir), ["sku", "description_sku"])


@query
def topn_by_count(spark, sf_dir):
    return quality.topn_by_count(_erp_lines(spark, sf_dir), "sku")


@query
def value_counts(spark, sf_dir):
    return quality.value_counts(_erp_lines(spark, sf_dir), "delivery_type")


@query
def histogram(spark, sf_dir):
    return quality.histogram(_erp_lines(spark, sf_dir), "quantity", -100, 999, 1)


def _price_bins(spark, sf_dir):
    return quality.equal_bin_histogram(_erp_lines(spark, sf_dir), "price_per_unit", 2000)


query(_price_bins, "equal_bin_histogram", digits=6)


@query
def monthly_amount(spark, sf_dir):
    return quality.monthly_amount(_erp_lines(spark, sf_dir))


@query
def yearly_split(spark, sf_dir):
    return quality.yearly_split(_erp_lines(spark, sf_dir), SKU)


@query
def descriptions_of_sku(spark, sf_dir):
    return quality.descriptions_of_sku(_erp_lines(spark, sf_dir), SKU, "loose")


@query
def positive_item_totals(spark, sf_dir):
    return quality.positive_item_totals(tables.sales_per_month(spark, sf_dir))


@query
def seasonal_totals(spark, sf_dir):
    months = tables.sales_per_month(spark, sf_dir)
    return (
        quality.seasonal_totals(months, "month").withColumnRenamed("month", "part")
        .union(quality.seasonal_totals(months, "year"))
    )


@query
def top_item_series(spark, sf_dir):
    return quality.top_item_series(tables.sales_per_month(spark, sf_dir))


@query
def null_measure_items(spark, sf_dir):
    sales = tables.sales(spark, sf_dir).withColumn("sales", F.nullif("sales", F.lit(50.0)))
    return quality.null_measure_items(sales, "sales")


@query
def rows_by_description(spark, sf_dir):
    rows = quality.rows_by_description(_erp_lines(spark, sf_dir), SKU, "loose")
    return rows.select("date", "sku", "description_sku", "quantity")


@query
def rows_by_presence(spark, sf_dir):
    lines = cleaning.coerce_numeric(
        cleaning.normalize_null_tokens(tables.inventory_text(spark, sf_dir)), ["COST"]
    )
    present, absent = (quality.rows_by_presence(lines, "COST", flag) for flag in (True, False))
    return present.withColumn("part", F.lit("set")).union(absent.withColumn("part", F.lit("missing"))).groupBy(
        "part", "TYPE"
    ).agg(F.count(F.lit(1)).alias("lines"), F.sum("COST").alias("cost"))


@query
def topn_by_sum(spark, sf_dir):
    return quality.topn_by_count(_erp_lines(spark, sf_dir), "sku", by_sum=True)


@query
def discount_histogram(spark, sf_dir):
    return quality.histogram(_erp_lines(spark, sf_dir), "discount_percentage", 0, 100, 1)


@query
def inventory_to_table(spark, sf_dir):
    """The whole way of an inventory export: envelopes, null tokens, numbers, typed table."""
    path = scratch_path(spark, "inventory")
    lines = tables.inventory_text(spark, sf_dir)
    lines.groupBy("DOC").agg(F.collect_list(F.struct(*lines.columns)).alias("value")).select(
        F.to_json(F.struct("value")).alias("value")
    ).write.text(path)
    raw = readers.load_json_envelope(spark, path, _text_schema(lines.columns), multi_line=False)
    numbers = [c for c in schemas.INVENTORY_NUMBERS if c in raw.columns]
    typed = cleaning.coerce_numeric(cleaning.normalize_null_tokens(raw), numbers)
    table = scratch_path(spark, "inventory-table")
    writers.append_table(typed, table, ["TYPE"])
    return spark.read.schema(typed.schema).parquet(table).groupBy("TYPE").agg(
        F.count(F.lit(1)).alias("lines"), F.count("COST").alias("costs"), F.sum("TQUANT").alias("TQUANT"),
        F.min("DOC").alias("first_doc"), F.max("KLINE").alias("last_line"),
    )


# ---------------------------------------------------------------- forecasting


def _panel(spark, sf_dir):
    return panel.build_panel(tables.stock_log(spark, sf_dir), MONTHLY)


def _results(spark, sf_dir):
    """Errors of the whole grid, a row per point and s with the windows as columns."""
    return tuning.forecast_errors(tuning.swa_grid(panel.extend_series(_panel(spark, sf_dir)), by_shift=True))


def _series(spark, sf_dir):
    return tuning.swa_series(panel.extend_series(_panel(spark, sf_dir)))


@query
def densify_panel(spark, sf_dir):
    return panel.densify_panel(tables.stock_log(spark, sf_dir), MONTHLY)


@query
def hierarchy_rollup(spark, sf_dir):
    return _panel(spark, sf_dir)


@query
def extend_series(spark, sf_dir):
    return panel.extend_series(_panel(spark, sf_dir))


@query
def swa_grid(spark, sf_dir):
    """The whole grid, summed up per hierarchy level and parameter pair."""
    grid = tuning.swa_grid(panel.extend_series(_panel(spark, sf_dir)), by_shift=True)
    columns = tuning.window_columns(grid, "SWA")
    sums = grid.groupBy(panel.hierarchy_level(F.col("unique_id")).alias("level"), "s").agg(
        F.count(F.lit(1)).alias("points"),
        *[F.count(c).alias(f"predicted_{c}") for c in columns], *[F.avg(c).alias(f"mean_{c}") for c in columns],
    )
    windows = tuning.by_window(
        columns, lambda c, n: F.col("points"), lambda c, n: F.col(f"predicted_{c}").alias("predicted"),
        lambda c, n: F.col(f"mean_{c}").alias("mean_prediction"),
    )
    return sums.select("level", "s", F.inline(windows))


@query
def forecast_errors(spark, sf_dir):
    """Errors of the whole grid, averaged per series."""
    results = _results(spark, sf_dir)
    counted = []
    for metric in tuning.METRICS:
        errors = [F.col(c) for c in tuning.window_columns(results, metric)]
        # the windows of a row are added up before the series is looked up
        counted += [
            F.sum(sum(F.coalesce(e, F.lit(0.0)) for e in errors)).alias(f"_{metric}"),
            F.sum(sum(e.isNotNull().cast("long") for e in errors)).alias(f"_n_{metric}"),
        ]
    return results.groupBy("unique_id").agg(*counted).select(
        "unique_id", F.col("_n_MAE").alias("errors"), F.try_divide("_MAE", "_n_MAE").alias("MAE"),
        F.col("_n_MAPE").alias("ratios"), F.try_divide("_MAPE", "_n_MAPE").alias("MAPE"),
    )


@query
def best_window(spark, sf_dir):
    return tuning.best_series_window(_series(spark, sf_dir), CHECK_START, CHECK_END)


def _best_forecast(spark, sf_dir):
    return tuning.best_series_forecast(_series(spark, sf_dir), CHECK_START, TARGET)


@query
def best_window_mape(spark, sf_dir):
    return tuning.best_window(_results(spark, sf_dir), CHECK_START, CHECK_END, "MAPE", ("w", "s"))


@query
def demand_panel(spark, sf_dir):
    """Panel of the demand movements and some categories only."""
    scope = Scope(
        "1996-01-01", "2000-12-31", "M", item_kind="category", item_values=CATEGORIES,
        movements=("return", "delivery"),
    )
    return panel.build_panel(tables.stock_log(spark, sf_dir), scope)


@query
def best_window_forecast(spark, sf_dir):
    return _best_forecast(spark, sf_dir)


@query
def actual_vs_forecast_wide(spark, sf_dir):
    return tuning.actual_vs_forecast_wide(_best_forecast(spark, sf_dir), CATEGORY_IDS)


@query
def reshape_forecast_columns(spark, sf_dir):
    """All points and pairs of the grid, widened, reshaped back and averaged per series."""
    rows = tuning.reshape_forecast_columns(tuning.widen_forecast_columns(_series(spark, sf_dir)), by_shift=True)
    columns, ends = tuning.window_columns(rows, "SWA"), ("SWA", "MAE", "MAPE")
    sums = rows.groupBy("unique_id", "s").agg(
        F.count(F.lit(1)).alias("points"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"),
        *[F.count(c).alias(f"predicted_{c}") for c in columns],
        *[F.avg(c).alias(f"mean_{c}") for end in ends for c in tuning.window_columns(rows, end)],
    )

    def mean(prefix: str, name: str):
        # means over twelve windows often end in a 5 at the last digit shown; the factor moves
        # these off the border, on which the order of a sum would decide
        return lambda c, n: (F.col(f"mean_{prefix}_w{n}") * (1 + 1e-9)).alias(name)

    windows = tuning.by_window(
        columns, lambda c, n: F.col("points"), lambda c, n: F.col(f"predicted_{c}").alias("predicted"),
        lambda c, n: F.col("first_ds"), lambda c, n: F.col("last_ds"),
        mean("SWA", "SWA_value"), mean("MAE", "MAE"), mean("MAPE", "MAPE"),
    )
    return sums.select("unique_id", "s", F.inline(windows))


def _train(spark, sf_dir):
    return _panel(spark, sf_dir).where(F.col("ds") < F.lit(TEST_START).cast("date"))


@query
def baseline_backtest(spark, sf_dir):
    return backtest.baseline_backtest(_train(spark, sf_dir))


@query
def backtest_stored(spark, sf_dir):
    """The backtest of a panel that is stored in buckets by series."""
    path = scratch_path(spark, "panel-by-series")
    stored.store_by_series(_train(spark, sf_dir).select(schemas.PANEL.names), path)
    return backtest.baseline_backtest(stored.open_by_series(spark, path, schemas.PANEL))


@query
def backtest_rmse(spark, sf_dir):
    return backtest.backtest_rmse(backtest.baseline_backtest(_train(spark, sf_dir)))


@query
def time_index_split(spark, sf_dir):
    return panel.time_index_split(_panel(spark, sf_dir), TEST_START)


@query
def auto_ar_forecast(spark, sf_dir):
    return autoregression.auto_ar_forecast(
        panel.time_index_split(_panel(spark, sf_dir), TEST_START)
    )


@query
def seasonal_ar_forecast(spark, sf_dir):
    return autoregression.seasonal_ar_forecast(
        panel.time_index_split(_panel(spark, sf_dir), TEST_START)
    )
