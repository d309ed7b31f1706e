"""The library's tables, built from the supplied relational tables.

A deployment has these tables already; here they are joins, so none of them is hinted: Spark
broadcasts a dimension only while its measured size is below the session's threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast import schemas
from shelfcast.operators.shared import spread

# Stored conversion rates, different from those of the converted reports.
STORED_RATES = {"ILS": 1.0, "USD": 3.72, "EUR": 4.03}
COINS = ["ILS", "USD", "EUR"]

# Words that occur in part names.
MATERIALS = {"ring": "ring", "red": "red"}
COLORS = {"blue": "blue", "red": "red", "ring": "ring", "bolt": "bolt"}
UNITS = ('MEDIUM', 'STANDARD', 'LARGE')
MOVEMENTS = {"R": "return", "A": "delivery", "N": "invoice"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Digits of item codes; two groups of three digits tell 62 ** 6, about 57 billion, parts apart.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def item_code(part: str = "p_partkey", brand: str = "p_brand") -> Column:
    """Eight characters: brand number, then the part number in two groups of three digits.

    The groups take turns at the part number's digits, so both vary for small numbers too. Every
    part number has a code of its own; one that needs more digits is an error.
    """
    base = len(DIGITS)
    key = F.when(
        F.col(part).between(0, base**6 - 1), F.col(part).cast("long")
    ).otherwise(F.raise_error(F.concat(F.lit("no item code for part "), F.col(part).cast("string"))).cast("long"))

    def digit(place: int) -> Column:
        return F.substring(F.lit(DIGITS), (F.floor(key / base**place) % base + 1).cast("int"), F.lit(1))

    number = F.lpad(F.substring(brand, 7, 10), 2, "0")
    return F.concat(number, *[digit(place) for place in (5, 3, 1, 4, 2, 0)])


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), item_code().alias("item"),
        F.col("p_name").alias("item_desc"), F.col("p_type").alias("unit"),
        F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("list_price"),
    )


def sales(spark: SparkSession, sf_dir: str, with_item: bool = True) -> DataFrame:
    """The sales table; reports that use no item column can leave the part table out."""
    dates = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("status_date"),
        F.col("o_orderstatus").alias("order_status"),
    )
    rows = read(spark, sf_dir, "lineitem").join(dates, "l_orderkey")
    item_columns = ["item", "item_desc", "unit"] if with_item else []
    if with_item:
        rows = rows.join(parts(spark, sf_dir), "l_partkey")
    return rows.select(
        "status_date", *item_columns, F.col("l_quantity").alias("sales"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total_price"),
        "order_status",
    )


def stock_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit(None).cast("string")
    for flag, name in MOVEMENTS.items():
        kind = F.when(F.col("l_returnflag") == flag, name).otherwise(kind)
    return read(spark, sf_dir, "lineitem").join(parts(spark, sf_dir), "l_partkey").select(
        F.to_date("l_shipdate").alias("cur_date"), kind.alias("inv_mov_type"), "item",
        F.col("item_desc").alias("desc_he"), F.col("l_quantity").alias("quantity"), "unit",
        F.to_date("l_shipdate").alias("update_date"),
        F.col("l_suppkey").cast("string").alias("supply_id"),
    )


def supply_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("supply_name"),
        F.get(F.array(*[F.lit(c) for c in COINS]), F.col("s_nationkey") % 3).alias("coin"),
        F.get(F.array(*[F.lit(STORED_RATES[c]) for c in COINS]), F.col("s_nationkey") % 3)
        .alias("rate"),
    )
    return read(spark, sf_dir, "lineitem").join(suppliers, "l_suppkey").select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_suppkey").alias("supply_id"), "supply_name",
        F.to_date("l_shipdate").alias("date"), F.col("l_linestatus").alias("status"),
        F.col("l_extendedprice").alias("total_price"),
        (100 * F.col("l_discount")).alias("discount_perc"), "coin",
        (F.col("l_extendedprice") * F.col("rate")).alias("total_price_ILS"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("cust_id"),
        F.to_date("o_orderdate").alias("status_date"), F.col("o_orderstatus").alias("order_status"),
        F.col("o_totalprice").alias("total_price_with_discount"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    regions = read(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return (
        read(spark, sf_dir, "customer").join(nations, "c_nationkey").join(regions, "n_regionkey")
        .select(
            F.col("c_custkey").alias("cust_id"), F.col("n_name").alias("country"),
            F.col("c_name").alias("address"), F.col("r_name").alias("state"),
        )
    )


def erp_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the ERP would export them: all text, under the export's own headers."""
    money = F.lit("₪")
    day = F.to_date("l_shipdate")
    line_total = F.round(F.col("l_extendedprice") * F.col("l_quantity"), 2) + F.when(
        F.col("l_returnflag") == "R", 1.0
    ).otherwise(0.0)
    short_year = F.when(F.col("l_linenumber") % 2 == 0, F.date_format(day, "yy")).otherwise(
        F.substring(F.date_format(day, "yyyy"), 2, 3)
    )
    # years before 2000 have no short form that means them
    year = F.when(F.year(day) >= 2000, short_year).otherwise(F.date_format(day, "yyyy"))
    text = {
        "date": F.concat(F.date_format(day, "d/M/"), year),
        "date_supply": F.date_format(F.date_add(day, 7), "d/M/yyyy"),
        "sku": F.lpad(F.col("l_partkey").cast("string"), 12, "0"),
        "quantity": F.format_number("l_quantity", 0),
        "discount_percentage": F.when(F.col("l_linenumber") == 7, F.lit("nan%")).otherwise(
            F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%"))
        ),
        "price_after_discount": F.concat(money, F.format_number("l_extendedprice", 2)),
        "price_per_unit": F.concat(money, F.format_number("list_price", 2)),
        "code_sales_person": F.col("l_suppkey").cast("string"),
        "description_sku": F.concat(F.col("item_desc"), F.lit(' 25 "'), F.col("unit"), F.lit('", loose')),
        "code_manufacturer": F.col("brand"),
        "total_in_line": F.concat(money, F.format_number(line_total, 2)),
        "county_destination": F.lit(None).cast("string"),
        "county_origin": F.lit("None"),
        "delivery_type": F.concat_ws("/", "l_returnflag", "l_linestatus"),
    }
    # an export comes in many files; a table of one row group would be formatted and cleaned by one task
    rows = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_returnflag", "l_linestatus", "l_shipdate",
    )
    lines = spread(rows, "l_orderkey").join(parts(spark, sf_dir), "l_partkey")
    return lines.select(*[text[new].alias(old) for old, new in schemas.ERP_HEADERS.items()])


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested orders: an order is a document, its lines give two, one or no items each, and orders
    without lines have none. An array holds the lines of one order."""
    key = F.col("l_orderkey").cast("string")
    quantity = F.col("l_quantity")

    def item(part: int, share: Column) -> Column:
        return F.struct(
            (F.col("l_linenumber") * 10 + part).alias("KLINE"), share.alias("TQUANT"),
            F.concat(F.lit("own-"), key).alias("ORDNAME"),
        )

    items = (
        F.when(F.col("l_returnflag") == "R", F.array(item(1, quantity), item(2, -quantity)))
        .when(F.col("l_returnflag") == "A", F.array(item(1, quantity)))
        .otherwise(F.slice(F.array(item(1, quantity)), 1, 0))
    )
    by_order = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.flatten(F.collect_list(items)).alias("items")
    )
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    nothing = F.array().cast(by_order.schema["items"].dataType)
    return orders.join(by_order, "l_orderkey", "left").select(
        key.alias("ORDNAME"), F.col("o_orderstatus").alias("STATUS"),
        F.coalesce("items", nothing).alias("ORDERITEMS_SUBFORM"),
    )


#: Texts that are no decimal numbers, though some readers take them for one.
NO_NUMBERS = ["x1", "12d", "1.5f", "0x1p3", "nan", "Infinity"]


def inventory_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory log lines as text, with ``None`` tokens and values that are no numbers."""
    junk = F.get(F.array(*[F.lit(x) for x in NO_NUMBERS]), F.col("l_linenumber") % len(NO_NUMBERS))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("DOC"),
        F.col("l_linenumber").cast("string").alias("KLINE"),
        F.when(F.col("l_returnflag") == "R", "None").otherwise(F.col("l_quantity").cast("string"))
        .alias("TQUANT"),
        F.when(F.col("l_linestatus") == "F", junk)
        .otherwise(F.col("l_extendedprice").cast("string")).alias("COST"),
        F.when(F.col("l_linestatus") == "F", F.lit("None")).otherwise(F.col("l_returnflag"))
        .alias("TYPE"),
    )


def pretty_envelopes(lines: DataFrame, files: int) -> DataFrame:
    """(part, value): the lines of ``files`` JSON envelopes, printed with a line per field, from a
    table of texts. Each part is one document."""
    fields = [
        F.concat(F.lit(f'      "{c}": '), F.coalesce(F.get(F.split(F.to_json(F.struct(c)), ":", 2), F.lit(1)), F.lit("null}")))
        for c in lines.columns
    ]
    element = F.concat(
        F.lit("    {\n"), F.array_join(F.transform(F.array(*fields), lambda f: F.substring(f, F.lit(1), F.length(f) - 1)), ",\n"),
        F.lit("\n    }"),
    )
    part = F.pmod(F.xxhash64(*lines.columns), F.lit(files)).alias("part")
    elements = lines.select(part, F.lit(1).alias("place"), element.alias("value"))
    ends = lines.sparkSession.range(files).select(
        F.col("id").alias("part"),
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("place"), F.lit('{\n  "context": "export",\n  "value": [').alias("value")),
                F.struct(F.lit(2).alias("place"), F.lit("  ]\n}").alias("value")),
            )
        ),
    )
    order = Window.partitionBy("part").orderBy("place", "value")
    # a comma goes ahead of all elements but a file's first
    comma = F.when((F.col("place") == 1) & (F.lag("place").over(order) == 1), F.lit("    ,\n")).otherwise(F.lit(""))
    return elements.unionByName(ends).select("part", F.concat(comma, "value").alias("value"))


#: Years that the supplied movements lie in.
FEED_YEARS = range(1995, 2002)


def month_columns() -> dict[str, str]:
    """Column name to first day of each month of the feed."""
    return {f"{y}-{m:02d}": f"{y}-{m:02d}-01" for y in FEED_YEARS for m in range(1, 13)}


def monthly_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moved quantity per item, of all movement types, with one column per month; NULL where the item
    has no rows."""
    log = stock_log(spark, sf_dir)
    months = log.withColumn("month", F.date_format("cur_date", "yyyy-MM"))
    return months.groupBy("item", "desc_he").pivot("month", list(month_columns())).agg(F.sum("quantity"))


def sales_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net quantity per item and month, months as ``YYYY-MM`` text; returns count negative."""
    log = stock_log(spark, sf_dir)
    signed = F.when(F.col("inv_mov_type") == "return", -2 * F.col("quantity")).otherwise(
        F.col("quantity")
    )
    return log.groupBy(
        "item", F.col("desc_he").alias("item_desc"), F.date_format("cur_date", "yyyy-MM").alias("date")
    ).agg(F.sum(signed).alias("sales"))
