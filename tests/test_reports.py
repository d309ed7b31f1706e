"""Report semantics on hand-made rows, and invariants on the tables."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from shelfcast.functions.filters import Scope
from shelfcast.operators import order_reports, sales_reports, supply_reports
from shelfcast.operators.shared import share_of_total
from shelfcast.plans import tables

D = dt.date
SCOPE = Scope("2024-04-01", "2024-06-20", "W")
SALES = "status_date date, item string, item_desc string, sales double, total_price double, order_status string, unit string"


def sales_rows(spark, rows):
    return spark.createDataFrame(
        [(d, i, t, q, p, "done", u) for d, i, t, q, p, u in rows], SALES
    )


@pytest.fixture(scope="module")
def sales(spark):
    return sales_rows(spark, [
        (D(2024, 4, 1), "20118207", "כיסא עור", 1.0, 10.0, "m"),
        (D(2024, 4, 6), "20118208", "בד כחול", 2.0, 20.0, "m"),
        (D(2024, 4, 7), "30118207", None, 3.0, 20.0, "kg"),
        (D(2024, 6, 20), "40118207", "x", 4.0, None, "m"),
        (D(2024, 6, 21), "20118207", "x", 99.0, 99.0, "m"),
        (D(2024, 3, 31), "20118207", "x", 99.0, 99.0, "m"),
        (D(2024, 5, 1), None, "אדום", 5.0, 500.0, "m"),
    ])


def test_week_before_start_is_kept(sales):
    rows = {r.period: r.total_price for r in sales_reports.period_totals(sales, SCOPE).collect()}
    assert rows[D(2024, 3, 31)] == 30.0 and rows[D(2024, 4, 7)] == 20.0
    assert len(rows) == 12 and sum(rows.values()) == 550.0 and rows[D(2024, 6, 16)] == 0.0


def test_filters_apply(sales):
    scope = Scope("2024-04-01", "2024-06-20", "M", units=("m",), item_kind="category", item_values=("20",))
    assert sales_reports.total_income(sales, scope).collect()[0][0] == 30.0
    nothing = Scope("2030-01-01", "2030-01-02", "D")
    assert sales_reports.total_income(sales, nothing).collect()[0][0] == 0.0


def test_topk_ties_by_item_and_null_items_in_others(sales):
    rows = sales_reports.topk_and_others(sales, SCOPE, k=1).collect()
    assert [(r.item_bucket, r.total_price) for r in rows] == [("others", 530.0), ("20118208", 20.0)]
    series = sales_reports.topk_item_series(sales, SCOPE, k=2).collect()
    assert {r.item for r in series} == {"20118208", "30118207"} and len(series) == 24
    wide = sales_reports.topk_item_wide(
        sales_reports.topk_item_series(sales, SCOPE, k=2), "total_price"
    )
    assert wide.columns == ["period", "20118208", "30118207"] and wide.count() == 12


def test_averages(sales):
    by_day = {r.day_of_week: r.avg_total_price for r in sales_reports.avg_by_weekday(sales, SCOPE).collect()}
    assert list(by_day) == sales_reports.WEEKDAYS
    assert by_day["Sunday"] == 20.0 and by_day["Tuesday"] == 0.0 and by_day["Monday"] == 10.0
    by_dom = sales_reports.avg_by_day_of_month(sales, SCOPE).collect()
    assert len(by_dom) == 31 and by_dom[0].avg_total_price == (10.0 + 500.0) / 2
    by_month = {r.month: r.avg_total_price for r in sales_reports.avg_by_month(sales, SCOPE).collect()}
    assert by_month == {4: 50.0 / 3, 5: 500.0, 6: None}


def test_mixes_sum_to_totals(sales):
    totals = {r.period: r.total_price for r in sales_reports.period_totals(sales, SCOPE).collect()}
    for mix in (sales_reports.material_mix_series, sales_reports.color_mix_series):
        for row in mix(sales, SCOPE).collect():
            assert sum(v for k, v in row.asDict().items() if k != "period") == totals[row.period]
    colors = {r.color: r.total_price for r in sales_reports.color_totals(sales, SCOPE).collect()}
    assert colors == {"blue": 20.0, "red": 500.0, "other": 30.0}


def test_income_vs_expense(spark, sales):
    supply = spark.createDataFrame(
        [(D(2024, 4, 2), "ok", 10.0, "USD", 37.1), (D(2024, 5, 2), "ok", 10.0, "EUR", 40.1),
         (D(2024, 5, 2), "no", 10.0, "ILS", 10.0), (D(2024, 6, 2), "ok", 10.0, "GBP", 47.0)],
        "date date, status string, total_price double, coin string, total_price_ILS double",
    )
    scope = Scope("2024-04-01", "2024-06-20", "M", supply_status=("ok",))
    run = lambda **kw: {
        r.period.month: (r.total_price, r.total_expense_ILS, r["diff"])
        for r in sales_reports.income_vs_expense(sales, supply, scope, **kw).collect()
    }
    assert run() == {4: (50.0, 37.0, 13.0), 5: (500.0, 40.0, 460.0), 6: (0.0, 10.0, -10.0)}
    assert run(unknown="null")[6] == (0.0, 0.0, 0.0)
    assert run(floor_date="2024-05-01")[4] == (0.0, 0.0, 0.0)
    status = supply_reports.supply_spend_by_status(supply, SCOPE).collect()
    assert [(r.status, r.total_expense_ILS) for r in status] == [("no", 10.0), ("ok", 87.0)]
    with pytest.raises(ValueError):
        run(unknown="zero")


def test_rolling_matches_pandas(spark):
    values = [float(v) for v in np.random.default_rng(3).integers(0, 50, 20)]
    days = pd.date_range("2024-04-01", periods=20)
    df = sales_rows(spark, [(d.date(), "i", "t", v, v, "m") for d, v in zip(days, values) if v])
    scope = Scope("2024-04-01", "2024-04-20", "D")
    expected = pd.Series(values).rolling(7)
    got = sales_reports.rolling_variance(df, scope).orderBy("period").toPandas()
    np.testing.assert_allclose(got.price_variance, expected.var())
    got = sales_reports.rolling_mean(df, scope).orderBy("period").toPandas()
    np.testing.assert_allclose(got.moving_average, expected.mean())


def stock(spark, rows):
    return spark.createDataFrame(
        rows, "update_date date, inv_mov_type string, quantity double, unit string, item string"
    )


def test_net_outgoing(spark):
    log = stock(spark, [
        (D(2024, 4, 1), "out", 10.0, "m", "a"), (D(2024, 4, 2), "back", 4.0, "m", "a"),
        (D(2024, 4, 16), "back", 3.0, "m", "a"), (D(2024, 4, 22), "out", 2.5, "m", "a"),
        (D(2024, 4, 22), "move", 100.0, "m", "a"),
    ])
    scope = Scope("2024-04-01", "2024-04-30", "W")
    run = lambda **kw: [
        r.net_quantity for r in
        supply_reports.net_outgoing(log, scope, ("out",), ("back",), **kw).orderBy("period").collect()
    ]
    assert run() == [6.0, 0.0, 0.0, 2.5, 0.0]
    assert run(keep_return_only=True) == [6.0, 0.0, -3.0, 2.5, 0.0]
    both = Scope("2024-04-01", "2024-04-30", "M", movements=("out", "back"))
    assert supply_reports.stock_movement_series(log, both).collect()[0].total_quantity == 19.5


def test_customers_listed_twice_and_unmatched(spark):
    orders = spark.createDataFrame(
        [("o1", "c1", D(2024, 4, 1), "done", 10.0), ("o2", "c1", D(2024, 4, 1), "done", 5.0),
         ("o3", "zz", D(2024, 4, 3), "done", 7.0), (None, None, D(2024, 4, 3), "done", 1.0)],
        "order_id string, cust_id string, status_date date, order_status string, total_price_with_discount double",
    )
    customers = spark.createDataFrame(
        [("c1", "IL", "a", "North"), ("c1", "IL", "b", "North"), ("c9", "FR", "c", "South")],
        "cust_id string, country string, address string, state string",
    )
    rows = order_reports.income_by_country(orders, customers, SCOPE).collect()
    assert [(r.cust_country, r.total_price_with_discount) for r in rows] == [("IL", 15.0), (None, 8.0)]
    label = order_reports.income_by_state(orders, customers, SCOPE, reverse_label=True).collect()[0].label
    assert label == "htroN - 15.00 ILS"
    daily = order_reports.orders_per_day(orders, SCOPE).collect()
    assert len(daily) == 81 and sum(r.order_count for r in daily) == 3
    unique = {r.period: r.unique_customers for r in order_reports.unique_customers_series(orders, SCOPE).collect()}
    assert unique[D(2024, 3, 31)] == 2 and len(unique) == 12


def test_histogram_edges(spark):
    values = [-0.1, 0.0, 9.99, 10.0, 2489.0, 2490.0, 2490.1, None]
    orders = spark.createDataFrame(
        [(str(i), "c", D(2024, 4, 1), "done", v) for i, v in enumerate(values)],
        "order_id string, cust_id string, status_date date, order_status string, total_price_with_discount double",
    )
    got = order_reports.order_value_histogram(orders, SCOPE).toPandas()
    known = [v for v in values if v is not None]
    counts, edges = np.histogram(known, bins=np.arange(0, 2500, 10))
    assert got["count"].tolist() == counts.tolist() and got.bin_start.tolist() == edges[:-1].tolist()


def test_shares_sum_to_hundred(spark, sf_dir):
    supply = tables.supply_orders(spark, sf_dir)
    shares = supply_reports.supply_spend_by_supplier(supply, Scope("1995-01-01", "2001-12-31"))
    assert abs(sum(r.share for r in shares.collect()) - 100) < 1e-9
    zero = spark.createDataFrame([("a", 0.0)], "k string, v double")
    assert share_of_total(zero, "v").collect()[0].share is None


def test_topk_and_others_sum_to_total(spark, sf_dir):
    scope = Scope("1995-01-01", "2001-12-31", "M")
    sales = tables.sales(spark, sf_dir)
    parts = sum(r.sales for r in sales_reports.topk_and_others(sales, scope, "sales").collect())
    whole = sum(r.sales for r in sales_reports.period_totals(sales, scope, "sales").collect())
    assert parts == whole


def test_customers_of_all_frequencies_from_one_pass(spark):
    import random

    from shelfcast.functions.calendar import period_start
    from shelfcast.operators import order_reports

    draw = random.Random(8)
    rows = [
        (f"o{i}", draw.choice([None, 1, 5, 32_768, 32_769, 70_000, 2**40 + 7]), dt.date(2023, 11, 1) + dt.timedelta(draw.randrange(200)), "F", 1.0)
        for i in range(600)
    ]
    orders = spark.createDataFrame(rows, "order_id string, cust_id long, status_date date, order_status string, total_price_with_discount double")
    scope = Scope("2023-11-15", "2024-04-30", "D")
    got = {(r.freq, r.period): r.unique_customers for r in order_reports.unique_customers_rollup(orders, scope).collect()}
    expected = {}
    for freq in "DWMQY":
        inside = scope.orders(orders).where("cust_id IS NOT NULL")
        for r in inside.groupBy(period_start("status_date", freq).cast("date").alias("p")).agg(F.count_distinct("cust_id").alias("n")).collect():
            expected[freq, r.p] = r.n
    assert got == expected
