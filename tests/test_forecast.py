"""Forecast operators against plain pandas and numpy."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.functions.filters import Scope
from shelfcast.operators import autoregression, backtest, panel, tuning

D = dt.date
SCOPE = Scope("2019-01-01", "2024-06-30", "M")


def month_ends(n, start="2020-01-31"):
    return [d.date() for d in pd.date_range(start, periods=n, freq="ME")]


def series_frame(spark, series, start="2020-01-31"):
    rows = [
        (d, uid, None if v is None else float(v))
        for uid, values in series.items()
        for d, v in zip(month_ends(len(values), start), values)
    ]
    return spark.createDataFrame(rows, "ds date, unique_id string, y double")


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        (D(2023, 1, 5), "20118207", 5.0), (D(2023, 1, 9), "20118207", 1.0),
        (D(2023, 4, 30), "20118207", 2.0), (D(2023, 1, 5), "20119207", 7.0),
        (D(2023, 2, 1), "30118207", 4.0), (D(2023, 2, 3), "30118207", None),
        (D(2023, 2, 3), None, 50.0), (D(2025, 1, 1), "20118207", 99.0),
    ]
    return spark.createDataFrame(
        [(d, "x", "m", i, q) for d, i, q in rows],
        "cur_date date, inv_mov_type string, unit string, item string, quantity double",
    )


def test_densify_uses_observed_months_only(log):
    got = {(r.item, r.ds): r.y for r in panel.densify_panel(log, SCOPE).collect()}
    months = [D(2023, 1, 31), D(2023, 2, 28), D(2023, 4, 30)]
    values = {"20118207": [6, 0, 2], "20119207": [7, 0, 0], "30118207": [0, 4, 0]}
    assert got == {(i, m): float(v) for i, vs in values.items() for m, v in zip(months, vs)}


def test_rollup_of_dense_equals_panel(log):
    dense = panel.densify_panel(log, SCOPE)
    rolled = {(r.unique_id, r.ds): r.y for r in panel.hierarchy_rollup(dense).collect()}
    built = {(r.unique_id, r.ds): r.y for r in panel.build_panel(log, SCOPE).collect()}
    assert built == rolled
    assert built[("20_category", D(2023, 1, 31))] == 13.0
    assert built[("118_catalog", D(2023, 2, 28))] == 4.0
    assert built[("118207_catalog+color", D(2023, 4, 30))] == 2.0
    by_level = {}
    for (uid, _), y in built.items():
        level = uid.split("_", 1)[1] if "_" in uid else "item"
        by_level[level] = by_level.get(level, 0) + y
    assert set(by_level.values()) == {19.0}


def test_levels(spark):
    df = spark.createDataFrame([("1",), ("20_category",), ("118_catalog",), ("4_catalog+color",)], "u string")
    assert [r[0] for r in df.select(panel.hierarchy_level(F.col("u"))).collect()] == [
        "item", "category", "catalog", "catalog+color"
    ]


def test_extend_series(spark):
    rows = [(D(2023, 1, 31), "a", 1.0), (D(2023, 3, 31), "a", 3.0), (D(2023, 12, 31), "b", 4.0)]
    df = spark.createDataFrame(rows, "ds date, unique_id string, y double")
    got = {}
    for r in panel.extend_series(df).orderBy("ds").collect():
        got.setdefault(r.unique_id, []).append((r.ds, r.y))
    future = month_ends(12, "2024-01-31")
    assert got["a"] == [(D(2023, 1, 31), 1.0), (D(2023, 2, 28), None), (D(2023, 3, 31), 3.0)] + [
        (d, None) for d in future
    ]
    assert got["b"] == [(D(2023, 12, 31), 4.0)] + [(d, None) for d in future]


def brute_grid(frame, shifts=12, windows=12):
    parts = []
    for uid, part in frame.sort_values("ds").groupby("unique_id"):
        for s in range(1, shifts + 1):
            for w in range(1, windows + 1):
                value = part.y.shift(s).rolling(w).mean()
                parts.append(part.assign(s=s, w=w, SWA_value=value))
    return pd.concat(parts)


@pytest.fixture(scope="module")
def grid(spark):
    rng = np.random.default_rng(11)
    series = {f"s{i}": [float(v) for v in rng.integers(-3, 30, n)] for i, n in enumerate((40, 26, 5, 1))}
    series["gap"] = [1.0, 2.0, None, 4.0] + [5.0] * 30
    series["flat"] = [0.0] * 30
    return series_frame(spark, series)


def test_grid_matches_pandas(grid):
    expected = brute_grid(grid.toPandas())
    got = tuning.swa_grid(grid).toPandas()
    keys = ["unique_id", "ds", "s", "w"]
    joined = expected.merge(got, on=keys, suffixes=("_e", ""))
    assert len(got) == len(expected) == len(joined)
    np.testing.assert_allclose(joined.SWA_value, joined.SWA_value_e, atol=1e-9)


def test_errors_are_signed_and_null_at_zero(spark):
    df = spark.createDataFrame([(2.0, 3.0), (-2.0, 3.0), (0.0, 3.0), (None, 1.0)], "y double, SWA_value double")
    rows = [(r.MAE, r.MAPE) for r in tuning.forecast_errors(df).collect()]
    assert rows == [(1.0, 0.5), (5.0, -2.5), (3.0, None), (None, None)]


def test_best_window_matches_pandas(grid):
    start, end = "2021-02-28", "2022-01-31"
    results = tuning.forecast_errors(tuning.swa_grid(grid))
    frame = results.toPandas()
    inside = frame[(frame.ds >= D(2021, 2, 28)) & (frame.ds <= D(2022, 1, 31))]
    for ties in (["s", "w"], ["w", "s"]):
        scores = inside.groupby(["unique_id", *ties]).MAE.mean().round(9).dropna().reset_index()
        expected = scores.loc[scores.groupby("unique_id").MAE.idxmin()]
        got = tuning.best_window(results, start, end, tie_order=ties).toPandas()
        assert set(map(tuple, got[["unique_id", "s", "w"]].values)) == set(
            map(tuple, expected[["unique_id", "s", "w"]].values)
        )
    with pytest.raises(ValueError):
        tuning.best_window(results, start, end, metric="RMSE")
    with pytest.raises(ValueError):
        tuning.best_window(results, start, end, tie_order=("s",))


def test_best_forecast_skips_pairs_missing_at_target(spark):
    values = {"a": [float(i % 4) for i in range(36)]}
    extended = panel.extend_series(series_frame(spark, values))
    results = tuning.forecast_errors(tuning.swa_grid(extended))
    best = tuning.best_window_forecast(results, "2022-01-31", "2023-05-31").orderBy("ds").toPandas()
    assert best.ds.iloc[-1] == D(2023, 5, 31) and len(best) == 17
    assert best.SWA_value.iloc[-1] is not None and not np.isnan(best.SWA_value.iloc[-1])
    # five months ahead of the data only shifts of five or more exist
    assert best.s.iloc[0] == 8 and best.w.iloc[0] == 1
    wide = tuning.actual_vs_forecast_wide(
        tuning.best_window_forecast(results, "2022-01-31", "2023-05-31"), ["a", "zz"]
    )
    assert wide.columns == ["month", "a_SWA_value", "a_y", "zz_SWA_value", "zz_y"] and wide.count() == 17


def test_series_rows_choose_what_results_choose(spark, grid):
    extended = panel.extend_series(grid)
    rows, results = tuning.swa_series(extended), tuning.forecast_errors(tuning.swa_grid(extended))
    known = lambda df: sorted(map(repr, map(tuple, df.collect())))
    for metric in tuning.METRICS:
        for ties in (("s", "w"), ("w", "s")):
            args = ("2021-02-28", "2022-01-31", metric, ties)
            assert known(tuning.best_series_window(rows, *args)) == known(tuning.best_window(results, *args))
            args = ("2021-02-28", "2023-05-15", metric, ties)
            mine, stored = tuning.best_series_forecast(rows, *args), tuning.best_window_forecast(results, *args)
            assert mine.columns == stored.columns
            assert known(mine) == known(stored) and mine.count() > 12
    one = tuning.best_series_forecast(rows, "2021-02-28", "2023-05-15", unique_ids=["s1"])
    assert {r.unique_id for r in one.collect()} == {"s1"}
    with pytest.raises(ValueError):
        tuning.best_series_window(rows, "2021-02-28", "2022-01-31", metric="RMSE")


def test_small_grids_have_other_sizes(spark, grid):
    expected = brute_grid(grid.toPandas(), shifts=3, windows=5)
    got = tuning.swa_grid(grid, windows=5, shifts=3).toPandas()
    joined = expected.merge(got, on=["unique_id", "ds", "s", "w"], suffixes=("_e", ""))
    assert len(got) == len(expected) == len(joined)
    np.testing.assert_allclose(joined.SWA_value, joined.SWA_value_e, atol=1e-9)


def test_widened_and_reshaped_is_the_grid(spark, grid):
    keys = ["unique_id", "ds", "y", "s", "w", "SWA_value", "MAE", "MAPE"]
    wide = tuning.widen_forecast_columns(tuning.swa_series(grid, 5), 5, 3)
    assert len([c for c in wide.columns if c.startswith("SWA_s")]) == 15
    long = tuning.reshape_forecast_columns(wide).select(keys).collect()
    plain = tuning.forecast_errors(tuning.swa_grid(grid, 5, 3)).select(keys).collect()
    assert sorted(map(repr, long)) == sorted(map(repr, plain))
    assert tuning.reshape_forecast_columns(wide, "other").count() == 0


def test_rows_by_shift_hold_the_same_grid_and_errors(spark, grid):
    keys = ["unique_id", "ds", "s", "w"]
    long = tuning.forecast_errors(tuning.swa_grid(grid, 5, 3)).select(*keys, "y", "SWA_value", "MAE", "MAPE")
    rows = tuning.forecast_errors(tuning.swa_grid(grid, 5, 3, by_shift=True))
    assert tuning.window_columns(rows, "MAPE") == [f"MAPE_w{w}" for w in range(1, 6)]
    assert rows.count() * 5 == long.count()
    ends = {"SWA": "SWA_value", "MAE": "MAE", "MAPE": "MAPE"}
    values = [lambda c, n, e=e, name=name: F.col(f"{e}_w{n}").alias(name) for e, name in ends.items()]
    again = rows.select("*", F.inline(tuning.by_window(tuning.window_columns(rows, "SWA"), *values)))
    assert sorted(map(repr, again.select(long.columns).collect())) == sorted(map(repr, long.collect()))
    wide = tuning.widen_forecast_columns(tuning.swa_series(grid, 5), 5, 3)
    reshaped = tuning.reshape_forecast_columns(wide, by_shift=True)
    assert sorted(map(repr, reshaped.select(rows.columns).collect())) == sorted(map(repr, rows.collect()))
    with pytest.raises(ValueError):
        tuning.reshape_forecast_columns(wide.drop("SWA_s2_w3"), by_shift=True)
    with pytest.raises(ValueError):
        tuning.forecast_errors(grid)
    args = ("2021-02-28", "2022-01-31")
    for metric in tuning.METRICS:
        plain = tuning.best_window(tuning.forecast_errors(tuning.swa_grid(grid)), *args, metric)
        by_shift = tuning.best_window(tuning.forecast_errors(tuning.swa_grid(grid, by_shift=True)), *args, metric)
        assert sorted(map(repr, by_shift.select(plain.columns).collect())) == sorted(map(repr, plain.collect()))


def test_series_rows_keep_their_longest_window(spark, grid):
    best = tuning.best_series_window(tuning.swa_series(grid, 2), "2021-02-28", "2022-01-31").collect()
    assert best and max(r.w for r in best) <= 2


def test_best_forecast_reads_other_points_than_those_judged(spark):
    """Ranges that leave out a series' first point, its target or all of it, and values with signs."""
    series = {"a": [float((i * 7) % 11 - 5) for i in range(36)], "b": [-0.0, 1.5, None, 2.25] * 9, "late": [3.0]}
    extended = panel.extend_series(series_frame(spark, series))
    rows, results = tuning.swa_series(extended), tuning.forecast_errors(tuning.swa_grid(extended))
    known = lambda df: sorted(map(repr, map(tuple, df.collect())))
    for start, target in (("2019-01-01", "2022-12-31"), ("2022-06-30", "2023-06-30"), ("2022-06-30", "2030-01-31")):
        for metric in tuning.METRICS:
            args = (start, target, metric)
            assert known(tuning.best_series_forecast(rows, *args)) == known(tuning.best_window_forecast(results, *args))


def test_significant_digits_are_those_of_the_text(spark):
    rng = np.random.default_rng(5)
    values = [0.0, -0.0, float("nan"), float("inf"), float("-inf"), None, 1e-320, 1e300, 9999999999.4, 1e9, 1e-12]
    values += [12.345678905, 1.0000000005, 0.99999999995, 2.5, 1 / 3, -2 / 3, 0.1 + 0.2, 123456789.05, 99999.999995]
    values += [float(x) for x in rng.normal(0, 1, 400) * 10.0 ** rng.integers(-14, 14, 400)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select(tuning.significant(F.col("v")).alias("a"), F.expr("try_cast(format_string('%.9e', v) AS double)").alias("b")).collect()
    assert [repr(r.a) for r in rows] == [repr(r.b) for r in rows] and len(rows) == len(values)


def test_stored_results_give_the_same_choice(spark, grid, tmp_path):
    from shelfcast import schemas
    from shelfcast.sources import writers

    path = str(tmp_path / "results")
    results = tuning.forecast_errors(tuning.swa_grid(grid))
    writers.store_results(results, path)
    writers.store_results(results, path)
    stored = spark.read.schema(schemas.SWA_RESULTS).parquet(path)
    assert stored.count() == results.count()
    args = ("2021-02-28", "2022-01-31")
    choose = lambda df: sorted(map(tuple, tuning.best_window(df, *args).collect()))
    assert choose(stored) == choose(results)


def test_reshape(spark):
    wide = spark.createDataFrame(
        [("u", "2024-01-31", None, "true_and_pred", 1.0, None), ("u", "2024-02-29", 2.0, "true_and_pred", 3.0, 5.0)],
        "unique_id string, ds string, y double, data_type string, SWA_s1_w1 double, SWA_s10_w2 double",
    )
    rows = {(r.ds, r.s, r.w): (r.y, r.SWA_value, r.MAE) for r in tuning.reshape_forecast_columns(wide).collect()}
    assert rows == {
        ("2024-01-31", 1, 1): (None, 1.0, None), ("2024-01-31", 10, 2): (None, None, None),
        ("2024-02-29", 1, 1): (2.0, 3.0, 1.0), ("2024-02-29", 10, 2): (2.0, 5.0, 3.0),
    }


def brute_backtest(y, h=4, step=9, folds=5):
    out = {}
    n, test = len(y), h + step * (folds - 1)
    for f in range(folds):
        c = n - test + f * step
        if c < 1:
            continue
        past = y[:c]
        for j in range(1, h + 1):
            back = lambda m, r: past[c - m + (j - 1) % m - r * m]
            out[(f, j)] = (
                past[-1], back(12, 0) if c >= 12 else None,
                sum(past[-6:]) / 6 if c >= 6 else None,
                (back(2, 0) + back(2, 1)) / 2 if c >= 4 else None,
            )
    return out


def test_backtest_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    series = {f"s{n}": [float(v) for v in rng.integers(0, 99, n)] for n in (40, 41, 43, 47, 52, 60, 69)}
    folds = backtest.baseline_backtest(series_frame(spark, series))
    rows = folds.collect()
    expected = {(u, *k): v for u, y in series.items() for k, v in brute_backtest(y).items()}
    assert {(r.unique_id, r.fold, r.h) for r in rows} == set(expected)
    for r in rows:
        assert (r.Naive, r.SeasonalNaive, r.WindowAverage, r.SeasonalWindowAverage) == pytest.approx(
            expected[(r.unique_id, r.fold, r.h)], nan_ok=True
        )
        position = len(series[r.unique_id]) - 40 + 9 * r.fold + r.h - 1
        assert r.y == series[r.unique_id][position]
    frame = folds.toPandas()
    scores = {(r.unique_id, r.model): r.mean_rmse for r in backtest.backtest_rmse(folds).collect()}
    for uid, part in frame.groupby("unique_id"):
        per_fold = part.groupby("fold").apply(
            lambda p: np.sqrt(((p.Naive - p.y) ** 2).mean()), include_groups=False
        )
        assert scores[(uid, "Naive")] == pytest.approx(per_fold.mean())


def test_time_index_split(spark):
    df = series_frame(spark, {"a": [1.0] * 6})
    rows = panel.time_index_split(df, "2020-04-01").orderBy("ds").collect()
    assert [(r.time_idx, r.part) for r in rows] == [
        (0, "train"), (1, "train"), (2, "train"), (3, "test"), (4, "test"), (5, "test")
    ]
    with pytest.raises(Exception, match="no rows in the test month"):
        panel.time_index_split(df, "2021-04-01").collect()


def brute_ar(y, h):
    y = np.array(y)
    d = np.diff(y)
    n = len(y) - 2
    if n < 5:
        return None
    t, t1, e, e1 = y[2:], y[1:-1], d[1:], d[:-1]
    fit = lambda a, b: np.linalg.lstsq(np.c_[np.ones(n), b], a, rcond=None)[0]
    clamp = lambda a, b: (lambda s: (a.mean() - s * b.mean(), s))(np.clip(fit(a, b)[1], -0.999, 0.999))
    candidates = [(((t - t.mean()) ** 2).sum(), 2, "mean"), (((e - e.mean()) ** 2).sum(), 2, "drift")]
    if np.ptp(t1) > 0:
        a, b = clamp(t, t1)
        candidates.append((((t - a - b * t1) ** 2).sum(), 3, "ar1"))
    if np.ptp(e1) > 0:
        c0, c1 = clamp(e, e1)
        candidates.append((((e - c0 - c1 * e1) ** 2).sum(), 3, "diff_ar1"))
    def aicc(item):
        sse, k, _ = item
        if sse <= max((t * t).sum(), 1) * 1e-12:
            return -np.inf
        return n * np.log(sse / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
    model = min(candidates, key=aicc)[2]
    out, last, step = [], y[-1], d[-1]
    for _ in range(h):
        if model == "mean":
            last = t.mean()
        elif model == "drift":
            last = last + e.mean()
        elif model == "ar1":
            last = a + b * last
        else:
            step = c0 + c1 * step
            last = last + step
        out.append(last)
    return model, out


def test_auto_ar_matches_recursion(spark):
    rng = np.random.default_rng(9)
    series = {}
    for i in range(25):
        noise = rng.normal(0, 3, 40)
        kind = i % 5
        if kind == 0:
            y = 50 + noise
        elif kind == 1:
            y = np.cumsum(2 + 0.3 * noise)
        elif kind == 2:
            y = np.zeros(40)
            for t in range(1, 40):
                y[t] = 5 + 0.8 * y[t - 1] + noise[t]
        elif kind == 3:
            step = np.zeros(40)
            for t in range(1, 40):
                step[t] = 0.7 * step[t - 1] + noise[t]
            y = np.cumsum(step)
        else:
            y = np.full(40, 7.0) if i == 4 else np.arange(40.0) * 2
        series[f"s{i}"] = y.tolist()
    split = panel.time_index_split(series_frame(spark, series), "2022-12-01")
    rows = autoregression.auto_ar_forecast(split).orderBy("unique_id", "h").collect()
    assert len(rows) == 25 * 5
    models = set()
    for uid, y in series.items():
        model, expected = brute_ar(y[:35], 5)
        mine = [r for r in rows if r.unique_id == uid]
        models.add(model)
        assert {r.model for r in mine} == {model}
        assert [r.time_idx for r in mine] == list(range(35, 40))
        np.testing.assert_allclose([r.forecast for r in mine], expected, rtol=1e-6, atol=1e-6)
    assert models == {"mean", "drift", "ar1", "diff_ar1"}


def test_auto_ar_short_series_is_null(spark):
    df = series_frame(spark, {"long": [float(i * i % 7) for i in range(12)]}).union(
        series_frame(spark, {"short": [1.0, 2.0, 4.0]}, "2020-08-31")
    )
    split = panel.time_index_split(df, "2020-11-01")
    rows = autoregression.auto_ar_forecast(split).where("unique_id = 'short'").collect()
    assert len(rows) == 2 and all(r.forecast is None and r.model is None for r in rows)


def yule_walker(y, h, season=12, top=12):
    """(form, order, forecasts) by solving the equations of every order on its own."""
    y = np.array(y)
    late = y[season:]
    if len(late) < 20:
        return None
    found = []
    for d, x in ((0, late), (1, late - y[: len(late)])):
        centred, m = x - x.mean(), len(x)
        c = [float((centred[: m - k] * centred[k:]).sum()) / m for k in range(top + 1)]
        for p in range(min(top, m - 4) + 1):
            if p and c[0] <= 1e-12:
                break
            lags = np.array([[c[abs(i - j)] for j in range(p)] for i in range(p)]).reshape(p, p)
            phi = np.linalg.solve(lags, c[1: p + 1]) if p else np.zeros(0)
            v, k = c[0] - float(phi @ c[1: p + 1]), p + 2
            aicc = m * np.log(v) + 2 * k + 2 * k * (k + 1) / (m - k - 1) if v > 1e-12 else -np.inf
            found.append((round(aicc, 7), d, p, phi, x))
    _, d, p, phi, x = min(found, key=lambda f: f[:3])
    z, values = list(x - x.mean()), list(y)
    for _ in range(h):
        z.append(sum(phi[j] * z[-1 - j] for j in range(p)))
        values.append(z[-1] + x.mean() + (values[-season] if d else 0))
    return ("seasonal" if d else "plain"), p, values[len(y):]


def test_seasonal_models_match_their_equations(spark):
    rng = np.random.default_rng(21)
    series = {"flat": [4.0] * 80, "perfect": [float(i % 12) for i in range(80)], "short": [1.0, 5.0] * 12}
    pattern = rng.normal(0, 6, 12)
    for i in range(12):
        noise, y = rng.normal(0, 1, 80), np.zeros(80)
        for t in range(2, 80):
            y[t] = (0.9, 0.5, 0.0)[i % 3] * y[t - 1] - (0.0, 0.3, 0.0)[i % 3] * y[t - 2] + noise[t]
        series[f"s{i}"] = (y + (pattern[np.arange(80) % 12] if i % 2 else 0)).tolist()
    split = panel.time_index_split(series_frame(spark, series), "2025-10-01")
    rows = autoregression.seasonal_ar_forecast(split).orderBy("unique_id", "h").collect()
    forms = set()
    for uid, y in series.items():
        mine, known = [r for r in rows if r.unique_id == uid], yule_walker(y[:69], 11)
        assert [r.h for r in mine] == list(range(1, 12))
        if uid == "short":
            assert all(r.forecast is None and r.form is None for r in mine)
            continue
        forms.add((known[0], known[1] > 0))
        assert {(r.form, r.order) for r in mine} == {known[:2]}, uid
        np.testing.assert_allclose([r.forecast for r in mine], known[2], rtol=1e-7, atol=1e-7)
        if uid.startswith("s") and int(uid[1:]) % 2:
            assert known[0] == "seasonal"
    assert len(forms) == 4
