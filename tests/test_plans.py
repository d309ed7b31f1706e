"""Physical plans: what reaches the scan, what is shuffled, what never appears."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from shelfcast.functions.filters import Scope, code_part_filter
from shelfcast.operators import order_reports, panel, sales_reports, tuning
from shelfcast.plans import catalog, tables

SCOPE = Scope("1996-01-01", "1997-12-31", "W")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


WRITING = {"load_delimited", "write_csv", "load_json_envelope", "append_table", "filter_and_publish", "inventory_to_table", "append_once", "publish_once", "load_delimited_rescued", "backtest_stored", "load_pretty_envelope"}


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in WRITING])
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    text = plan(catalog.queries()[name](spark, sf_dir))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "ExistingRDD"):
        assert forbidden not in text


def test_date_filter_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(sales_reports.period_totals(tables.sales(spark, sf_dir, with_item=False), SCOPE))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[([^\]]*)", text)
    orders = next(s for s in scans if "o_orderdate" in s[0])
    assert "GreaterThanOrEqual(o_orderdate" in orders[1] and "LessThan" in orders[1]
    assert "o_totalprice" not in text and "l_tax" not in text


def test_leading_code_part_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.createDataFrame([("20118207", 1)], "item string, v int").write.parquet(path)
    df = spark.read.schema("item string, v int").parquet(path).where(code_part_filter(["20", "31"], 0, 2))
    assert "StringStartsWith(item,20)" in plan(df)


def test_unused_customers_are_not_joined(spark, sf_dir):
    text = plan(order_reports.order_value_histogram(tables.orders(spark, sf_dir), SCOPE))
    assert "Join" not in text


def test_reports_need_one_shuffle(spark, sf_dir):
    sales = spark.createDataFrame([], "status_date date, item string, item_desc string, sales double, total_price double, order_status string, unit string")
    for report in (sales_reports.period_totals, sales_reports.qty_vs_income,
                   sales_reports.material_mix_series, sales_reports.color_mix_series):
        assert plan(report(sales, SCOPE)).count("Exchange") == 1


def test_grid_and_scores_share_one_shuffle(spark):
    series = spark.createDataFrame([], "ds date, unique_id string, y double")
    results = tuning.forecast_errors(tuning.swa_grid(series))
    assert plan(results).count("Exchange") == 1
    best = plan(tuning.best_window(results, "2023-01-31", "2023-12-31"))
    assert best.count("Exchange") == 1 and "Window" in best
    # the date range is applied before the points are multiplied by the pairs
    assert best.index("Generate explode") < best.index(">= 2023-01-31") < best.index("Generate posexplode")


def test_series_rows_are_scored_and_reshaped_without_a_shuffle_of_their_own(spark):
    series = spark.createDataFrame([], "ds date, unique_id string, y double")
    rows = tuning.swa_series(series)
    assert plan(rows).count("Exchange") == 1
    wide = tuning.widen_forecast_columns(rows)
    for df in (
        tuning.best_series_window(rows, "2023-01-31", "2023-12-31"), tuning.best_series_forecast(rows, "2023-01-31", "2023-12-31"),
        wide, tuning.reshape_forecast_columns(wide),
    ):
        text = plan(df)
        assert text.count("Exchange") == 1 and "Join" not in text
    # the reshaping itself aggregates nothing
    above = plan(tuning.reshape_forecast_columns(wide)).split("Exchange")[0]
    assert above.count("Aggregate") == plan(rows).split("Exchange")[0].count("Aggregate")


def test_grid_work_is_in_generated_code(spark):
    """No lambda: Spark interprets them, element by element."""
    series = spark.createDataFrame([], "ds date, unique_id string, y double")
    rows = tuning.swa_series(series)
    wide = tuning.widen_forecast_columns(rows)
    args = ("2023-01-31", "2023-12-31")
    grid = tuning.forecast_errors(tuning.swa_grid(series, by_shift=True))
    for df in (
        rows, grid, tuning.best_window(grid, *args), tuning.best_series_window(rows, *args),
        tuning.best_series_forecast(rows, *args), tuning.reshape_forecast_columns(wide, by_shift=True),
    ):
        assert "lambda" not in plan(df)


def test_wide_columns_are_not_copied_into_the_reshaping(spark):
    """In one generated loop they are a method too large for the JVM to compile."""
    rows = tuning.swa_series(spark.createDataFrame([], "ds date, unique_id string, y double"))
    wide = tuning.widen_forecast_columns(rows)
    for by_shift in (False, True):
        text = plan(tuning.reshape_forecast_columns(wide, by_shift=by_shift))
        # a filter is between the array of the columns and their look-ups
        above, below = text.split("(_row", 1)
        assert "points#" not in above.split("Generate posexplode", 1)[1] and "points#" in below


def test_groups_of_the_grid_are_looked_up_once_per_shift(spark, sf_dir):
    """The summaries of the grid group rows of twelve windows, not single values."""
    for name in ("swa_grid", "forecast_errors", "best_window_mape", "reshape_forecast_columns"):
        keys = re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", plan(catalog.queries()[name](spark, sf_dir)))
        assert keys and not any(re.search(r"\bw#", k) for k in keys)


def test_a_panel_dealt_out_by_series_is_not_shuffled_again(spark, sf_dir):
    panel_rows = catalog._panel(spark, sf_dir)
    before = plan(panel.extend_series(panel_rows)).count("Exchange hashpartitioning")
    assert plan(tuning.swa_grid(panel.extend_series(panel_rows))).count("Exchange hashpartitioning") == before


def test_a_stored_panel_is_not_shuffled(spark, tmp_path):
    from shelfcast import schemas
    from shelfcast.operators import autoregression, backtest
    from shelfcast.sources import stored

    path = str(tmp_path / "panel")
    rows = [(f"s{i % 5}", f"2023-{1 + i // 5:02d}-28", float(i)) for i in range(60)]
    made = spark.createDataFrame(rows, "unique_id string, ds string, y double").selectExpr("ds", "unique_id", "y")
    made = made.withColumn("ds", F.last_day(F.to_date("ds"))).select(schemas.PANEL.names)
    for _ in range(2):
        stored.store_by_series(made, path, 4)
    kept = stored.open_by_series(spark, path, schemas.PANEL, 4)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, made.collect()))
    extended, split = panel.extend_series(kept), panel.time_index_split(kept, "2023-10-01")
    results = tuning.forecast_errors(tuning.swa_grid(extended))
    for df in (
        results, tuning.best_window(results, "2023-06-30", "2023-12-31"), tuning.best_series_window(tuning.swa_series(extended), "2023-06-30", "2023-12-31"),
        backtest.baseline_backtest(kept), autoregression.auto_ar_forecast(split), autoregression.seasonal_ar_forecast(split),
    ):
        assert "Exchange hashpartitioning" not in plan(df)
        df.collect()


def test_seasonal_models_are_chosen_in_the_row_of_their_series(spark):
    """No join back to the series and no row per model; products with followers are sums of one aggregate."""
    from shelfcast.operators import autoregression

    split = spark.createDataFrame([], "unique_id string, time_idx int, part string, y double")
    text = plan(autoregression.seasonal_ar_forecast(split))
    assert "Join" not in text and "partial_sum(_0_0" in text


def test_panel_subqueries_read_the_shuffle_of_the_main_branch(spark, sf_dir):
    """The panel's end is read from the shuffle already written, without another table scan."""
    df = catalog.queries()["extend_series"](spark, sf_dir)
    df.collect()
    subquery = plan(df).split("== Initial Plan ==")[0].split("Subquery subquery", 1)[1]
    assert "ReusedExchange" in subquery and "FileScan" not in subquery


def test_broadcasts_are_bounded(spark):
    """Hinted broadcasts are k rows, never the fact table."""
    sales = spark.createDataFrame([], "status_date date, item string, item_desc string, sales double, total_price double, order_status string, unit string")
    text = plan(sales_reports.topk_and_others(sales, SCOPE))
    assert re.search(r"BroadcastExchange[^\n]*\n[^\n]*(Project[^\n]*\n[^\n]*)?TakeOrderedAndProject", text)
