"""Readers, writers and ingest operators through real files."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast import schemas
from shelfcast.operators import ingest
from shelfcast.sources import readers, writers


def test_load_delimited_with_index_and_doubled_quotes(spark, tmp_path):
    path = tmp_path / "supply.csv"
    path.write_text(
        ",order_id,supply_id,supply_name,date,supply_order,status,total_price,discount_perc,coin,"
        "total_price_ILS,details\n"
        '0,A1,7,Alpha,2023-11-19,None,open,641.25,0,USD,2372.63,"8 rolls of ""felt"", grey"\n'
        "1,A2,8,Beta,2024-04-04,55,open,1.5,2.5,EUR,6.1,plain\n", encoding="utf-8",
    )
    rows = readers.load_delimited(spark, str(path), schemas.SUPPLY_ORDERS, index_column=True)
    first, second = rows.orderBy("order_id").collect()
    assert rows.columns == schemas.SUPPLY_ORDERS.names
    assert first.details == '8 rolls of "felt", grey' and first.supply_order == "None"
    assert first.date == dt.date(2023, 11, 19) and float(second.discount_perc) == 2.5


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "n int, t string")
    writers.write_csv(df, str(tmp_path / "out"))
    back = readers.load_delimited(spark, str(tmp_path / "out"), df.schema).orderBy("n")
    assert [tuple(r) for r in back.collect()] == [(1, 'a "b", c'), (2, None)]


def orders_document():
    return {
        "context": "x",
        "value": [
            {"ORDNAME": "A", "CUST": "c1",
             "ORDERITEMS_SUBFORM": [{"KLINE": 1, "ORDNAME": "own"}, {"KLINE": 2}]},
            {"ORDNAME": "B", "CUST": "c2", "ORDERITEMS_SUBFORM": []},
        ],
    }


ITEM = T.StructType([T.StructField("KLINE", T.IntegerType()), T.StructField("ORDNAME", T.StringType())])
ORDER_SCHEMA = T.StructType([
    T.StructField("ORDNAME", T.StringType()), T.StructField("CUST", T.StringType()),
    T.StructField("ORDERITEMS_SUBFORM", T.ArrayType(ITEM)),
])


def test_json_envelope_and_order_items(spark, tmp_path):
    path = tmp_path / "orders.json"
    path.write_text(json.dumps(orders_document(), indent=2), encoding="utf-8")
    orders = readers.load_json_envelope(spark, str(path), ORDER_SCHEMA)
    items = ingest.explode_order_items(orders).orderBy("KLINE")
    assert [tuple(r) for r in items.collect()] == [(1, "A"), (2, "A")]
    assert items.columns == ["KLINE", "ORDNAME"]
    headers = ingest.order_headers(orders)
    assert headers.columns == ["ORDNAME", "CUST"] and headers.count() == 2


def test_write_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    writers.append_table(df, path, ["k"])
    writers.append_table(df, path, ["k"])
    count = lambda: spark.read.schema("v int, k string").parquet(path).count()
    assert count() == 4
    writers.append_table(df.where("k = 'a'"), path, ["k"], "overwrite_partitions")
    assert count() == 3
    with pytest.raises(ValueError):
        writers.append_table(df, path, (), "overwrite_partitions")
    with pytest.raises(ValueError):
        writers.append_table(df, path, (), "merge")


def test_publish_one_series(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([("20_category", 1.0), ("x", 2.0)], "unique_id string, y double")
    writers.filter_and_publish(df, path, ["20_category"])
    assert [r.unique_id for r in spark.read.schema(df.schema).parquet(path).collect()] == ["20_category"]


def test_conform_erp_lines(spark):
    names = list(schemas.ERP_HEADERS)
    row = ["1/2/24", "31/2/2024", "0012.0", "1,000", "5%", "₪1,234.50", "x", "s", "d", "m",
           "₪10", "IL", "IL", "sea"]
    raw = spark.createDataFrame([row], T.StructType([T.StructField(n, T.StringType()) for n in names]))
    line = ingest.conform_erp_lines(raw).collect()[0]
    assert (line.date, line.date_supply, line.sku) == (dt.date(2024, 2, 1), None, "12")
    assert (line.quantity, line.discount_percentage, line.price_per_unit) == (1000.0, 5.0, None)
    assert line.line_amount == 1234500.0 and "county_origin" not in line.asDict()


def test_feed_to_stock_log(spark):
    feed = spark.createDataFrame(
        [("20118207", "chair", 3.0, None), (None, "lost", 1.0, 1.0), ("9", None, None, 4.0)],
        "item string, desc_he string, `5` double, `6` double",
    )
    months = {"5": "2023-05-01", "6": "2023-06-01"}
    long = ingest.unpivot_month_columns(feed, months)
    assert sorted((r.item, r.desc_he, str(r.date), r.quantity) for r in long.collect()) == [
        ("20118207", "chair", "2023-05-01", 3.0), ("20118207", "chair", "2023-06-01", 0.0),
        ("9", "0", "2023-05-01", 0.0), ("9", "0", "2023-06-01", 4.0),
    ]
    log = spark.createDataFrame(
        [("20118207", "m"), ("20118207", "kg"), ("20118207", None)], "item string, unit string"
    )
    conformed = ingest.conform_stock_log(ingest.with_representative_unit(long, log))
    assert conformed.schema.names == schemas.STOCK_LOG.names
    assert [f.dataType for f in conformed.schema] == [f.dataType for f in schemas.STOCK_LOG]
    units = {(r.item, r.unit, r.supply_name, r.UCOST, r.trans_id) for r in conformed.collect()}
    assert units == {("20118207", "kg", None, 0.0, "0"), ("9", None, None, 0.0, "0")}


def test_conform_to_schema(spark):
    df = spark.createDataFrame([("7", "x")], "sales string, item string")
    row = ingest.conform_to(df, schemas.SALES).collect()[0]
    assert row.sales == 7.0 and row.item == "x" and row.unit is None


def test_yearly_amount_fills_empty_years(spark):
    df = spark.createDataFrame(
        [(dt.date(2022, 5, 1), 3.0), (dt.date(2024, 5, 1), 4.0)], "date date, line_amount double"
    )
    rows = ingest.yearly_amount(df, "2022-01-01", "2024-12-31").orderBy("period").collect()
    assert [r.line_amount for r in rows] == [3.0, 0.0, 4.0]


def test_scratch_path_uses_the_cluster_setting(spark):
    from shelfcast.session import scratch_path

    shared = spark.conf.get("spark.checkpoint.dir", None)
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second
    if shared:
        assert first.startswith(f"{shared.rstrip('/')}/x-")


def test_runs_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "once")
    schema = "k string, d int, v int"
    first = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), (None, 2, 3)], schema)
    read = lambda: sorted((tuple(r) for r in spark.read.schema(schema).parquet(path).select("k", "d", "v").collect()), key=repr)
    writers.append_once(first, path, "one", ["k", "d"])
    expected = read()
    writers.append_once(first, path, "one", ["k", "d"])
    assert read() == expected and len(expected) == 3
    # another run adds the rows whose keys are new, and its repetition nothing
    second = first.union(spark.createDataFrame([("b", 1, 9)], schema))
    for _ in range(2):
        writers.append_once(second, path, "two", ["k", "d"])
        assert read() == sorted([*expected, ("b", 1, 9)], key=repr)
    # what a stopped run has left is replaced by its next try
    spark.createDataFrame([("c", 1, 1)], schema).withColumn("run", F.lit("three")).write.mode("append").partitionBy("run").parquet(path)
    writers.append_once(spark.createDataFrame([("c", 1, 1), ("c", 2, 1)], schema), path, "three", ["k", "d"])
    assert len(read()) == 6
    with pytest.raises(ValueError):
        writers.append_once(first, path, "one", [])


def test_publishing_a_run_twice(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([(dt.date(2024, 1, 31), "x", 1.0), (dt.date(2024, 2, 29), "y", 2.0)], schemas.PANEL)
    for run, ids in (("r1", ["x"]), ("r1", ["x"]), ("r2", ["x", "y"])):
        writers.filter_and_publish(df, path, ids, run=run)
    assert sorted(r.unique_id for r in spark.read.schema(schemas.PANEL).parquet(path).collect()) == ["x", "y"]


def test_rows_that_do_not_fit_are_rescued(spark, tmp_path):
    path = tmp_path / "raw"
    path.mkdir()
    (path / "a.csv").write_text('n,day,t\n1,2024-01-31,"a ""b"""\nx,2024-01-31,c\n2,31/01/2024,d\n3,2024-02-01,e,f\n4\n', encoding="utf-8")
    (path / "b.csv").write_text("n,day,t\n5,,\n", encoding="utf-8")
    rows = readers.load_delimited(spark, str(path), T.StructType.fromDDL("n int, day date, t string"), rescued=True)
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    writers.quarantine(rows, good, bad)
    kept = spark.read.parquet(good)
    assert kept.columns == ["n", "day", "t"]
    assert sorted(r.n for r in kept.collect()) == [1, 5]
    lost = spark.read.parquet(bad).collect()
    assert sorted(r[readers.RESCUED] for r in lost) == ["2,31/01/2024,d", "3,2024-02-01,e,f", "4", "x,2024-01-31,c"]
    assert all(r[readers.SOURCE].endswith("a.csv") for r in lost)
    # a query of one column judges rows by all of them
    assert rows.where(F.col(readers.RESCUED).isNull()).select("t").count() == 2
    plain = readers.load_delimited(spark, str(path), T.StructType.fromDDL("n int, day date, t string"))
    assert plain.columns == ["n", "day", "t"] and plain.count() == 6


def test_pretty_envelopes_are_read_in_ranges(spark, tmp_path):
    rows = [
        {"KLINE": i, "ORDNAME": f'tricky "x" \\n    }} {{ , [ ] é {i}', "deep": [{"a": {"b": i}}, {}], "none": None} for i in range(400)
    ]
    path = tmp_path / "big.json"
    for newline in ("\n", "\r\n"):
        for indent in (1, 2, 4, "\t"):
            with open(path, "w", encoding="utf-8", newline=newline) as out:
                json.dump({"context": {"a": [1, 2]}, "value": rows, "count": 400}, out, indent=indent, ensure_ascii=False)
            spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            try:
                found = readers.load_pretty_envelope(spark, str(path), ITEM)
                assert sorted((r.KLINE, r.ORDNAME) for r in found.collect()) == [(r["KLINE"], r["ORDNAME"]) for r in rows]
                assert found.rdd.getNumPartitions() > 8
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
                spark.conf.unset("spark.sql.files.openCostInBytes")
            whole = readers.load_json_envelope(spark, str(path), ITEM)
            assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, found.collect()))


def test_other_layouts_are_errors_and_empty_ones_nothing(spark, tmp_path):
    def read(document, indent=2):
        path = tmp_path / f"{abs(hash(str(document)))}-{indent}.json"
        path.write_text(json.dumps(document, indent=indent), encoding="utf-8")
        return readers.load_pretty_envelope(spark, str(path), ITEM).collect()

    one = {"KLINE": 1, "ORDNAME": "a"}
    assert [r.KLINE for r in read({"value": [one]})] == [1] and read({"value": []}) == []
    for wrong in ({"value": [one, {}, one]}, {"value": [one], "other": [one]}, {"other": [one]}, {"value": [one, None, one]}):
        with pytest.raises(Exception, match="not an envelope"):
            read(wrong)
    with pytest.raises(Exception, match="not an envelope"):
        read({"value": [one]}, None)
