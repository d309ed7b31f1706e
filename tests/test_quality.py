"""Profiles and checks against numpy and pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import quality


@pytest.mark.parametrize("name", ["uniform", "skewed", "ties", "constant", "outlier", "single"])
def test_exact_quantiles(spark, name):
    rng = np.random.default_rng(5)
    data = {
        "uniform": rng.random(5000), "skewed": np.exp(rng.normal(0, 6, 5000)),
        "ties": rng.integers(0, 5, 5000).astype(float), "constant": np.full(100, 3.5),
        "outlier": np.concatenate([rng.random(4999) * 1e-6, [1e12]]), "single": np.array([7.25]),
    }[name]
    df = spark.createDataFrame(pd.DataFrame({"v": data, "w": -data})).union(
        spark.sql("SELECT CAST(NULL AS DOUBLE), DOUBLE('NaN')")
    )
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quality.exact_quantiles(df, ["v", "w"], probabilities).toPandas()
    for column, values in (("v", data), ("w", -data)):
        part = got[got["column"] == column].sort_values("probability")
        assert part.probability.tolist() == probabilities
        np.testing.assert_allclose(part["quantile"], np.quantile(values, probabilities), rtol=1e-12)


def test_profile_matches_describe(spark):
    frame = pd.DataFrame({"a": np.random.default_rng(1).normal(5, 2, 1000), "b": np.arange(1000.0)})
    got = quality.profile_columns(spark.createDataFrame(frame), ["a", "b"]).toPandas().set_index("column")
    described = frame.describe().T
    for ours, theirs in {"count": "count", "mean": "mean", "std": "std", "min": "min", "q25": "25%",
                         "q50": "50%", "q75": "75%", "max": "max"}.items():
        np.testing.assert_allclose(got.loc[["a", "b"], ours].astype(float), described[theirs])


def test_schema_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "n int, `odd name` string")
    rows = [tuple(r) for r in quality.schema_and_nulls(df).orderBy("position").collect()]
    assert rows == [(0, "n", "int", 2, 0), (1, "odd name", "string", 1, 1)]


def test_mismatch_counts_missing_sides(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0), (1.0, 2.0), (None, None), (float("nan"), float("nan"))], "a double, b double"
    )
    assert quality.line_total_mismatch(df, "a", "b").count() == 3
    assert tuple(quality.line_total_summary(df, "a", "b").collect()[0]) == (3, 1)


def test_counts(spark):
    df = spark.createDataFrame(
        [("a", "x", 1.0), ("a", "y", None), ("b", "x", 9.0), ("c", None, 1.0), (None, "x", 1.0)],
        "sku string, d string, quantity double",
    )
    assert tuple(quality.distinct_counts(df, ["sku", "d"]).collect()[0]) == (5, 3, 2)
    assert [tuple(r) for r in quality.topn_by_count(df, "sku", n=2).collect()] == [("a", 1), ("b", 1)]
    assert [tuple(r) for r in quality.topn_by_count(df, "sku", n=1, by_sum=True).collect()] == [("b", 9.0)]
    assert [tuple(r) for r in quality.value_counts(df, "d").collect()] == [("x", 3), ("y", 1)]
    assert quality.null_measure_items(df, "quantity", "sku").collect()[0].sku == "a"
    assert quality.rows_by_presence(df, "d", True).count() == 4
    assert quality.rows_by_presence(df, "d", False).count() == 1


@pytest.mark.parametrize("values", [[1.0, 2.5, 9.0, 9.0, None], [4.0, 4.0], np.linspace(0, 1, 11).tolist()])
def test_equal_bins_match_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = quality.equal_bin_histogram(df, "v", 4).toPandas()
    counts, edges = np.histogram([v for v in values if v is not None], bins=4)
    assert got["count"].tolist() == counts.tolist()
    np.testing.assert_allclose(got.bin_start, edges[:-1])


def test_fixed_edge_histogram(spark):
    values = [-101.0, -100.0, 0.5, 998.0, 999.0, 1000.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = quality.histogram(df, "v", -100, 999, 1).toPandas()
    assert got["count"].tolist() == np.histogram(values, bins=np.arange(-100, 1000, 1))[0].tolist()


def test_descriptions(spark):
    df = spark.createDataFrame(
        [("1", "red chair", 1.0), ("1", "sofa", 1.0), ("1", None, 1.0), ("2", "red", 1.0)],
        "sku string, description_sku string, quantity double",
    )
    assert quality.rows_by_description(df, "1", "red").count() == 1
    assert quality.rows_by_description(df, "1", "red", contains=False).count() == 1
    rows = quality.descriptions_of_sku(df, "1", "red").collect()
    assert [tuple(r) for r in rows] == [("red chair", 1, True), ("sofa", 1, False)]


def test_split_and_top_items(spark):
    df = spark.createDataFrame(
        [("1", "2023-05-01", 3.0), ("2", "2023-06-01", 4.0), (None, "2024-06-01", 5.0), ("3", "2024-06-01", -9.0)],
        "sku string, day string, line_amount double",
    )
    dated = df.withColumn("date", F.to_date("day"))
    rows = [(r.period.year, r.own_amount, r.other_amount) for r in quality.yearly_split(dated, "1").collect()]
    assert rows == [(2023, 3.0, 4.0), (2024, 0.0, -4.0)]
    assert [r.sku for r in quality.positive_item_totals(df, "sku", "line_amount").collect()] == ["1", "2"]
    top = quality.top_item_series(df, 1, "sku", "line_amount")
    low = quality.top_item_series(df, 1, "sku", "line_amount", ascending=True)
    assert [r.sku for r in top.collect()] == ["2"] and [r.sku for r in low.collect()] == ["1"]
    months = quality.seasonal_totals(df, "month", "day", "line_amount").collect()
    assert [tuple(r) for r in months] == [("05", 3.0), ("06", 0.0)]


def test_quantiles_of_heavy_tails_read_little_value_by_value(spark):
    """One value of 1e15 among small ones: exact all the same, two reads, narrow brackets."""
    values = [((i * 7919) % 100_003) / 1000 for i in range(40_000)] + [1e15, -1e15]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = {r.probability: r.quantile for r in quality.exact_quantiles(df, ["v"], [0.25, 0.5, 0.75]).collect()}
    assert found == {p: pytest.approx(float(np.quantile(values, p)), rel=1e-12) for p in found}
    points = [0.5 - quality.MARGIN, 0.5 + quality.MARGIN]
    low, high = df.agg(F.percentile_approx("v", points, quality.SKETCH_ACCURACY)).first()[0]
    assert df.where(F.col("v").between(low, high)).count() < len(values) / 500


def test_profiles_read_the_table_twice(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = quality.profile_columns(df, ["l_quantity", "l_tax"])._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 2
