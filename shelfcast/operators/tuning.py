"""Shifted moving-average forecasts, their errors and the choice of parameters."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("MAE", "MAPE")
# Mean metrics are compared at this many digits behind the first, whatever their size, so equal
# pairs tie in whichever order they were summed.
SCORE_DIGITS = 9


#: Powers of ten that are exact doubles.
_TENS = [float(10**k) for k in range(23)]


def significant(value: Column, digits: int = SCORE_DIGITS) -> Column:
    """``value`` at 1 + ``digits`` significant digits.

    Scaled to that many digits, a number is rounded and divided by the same exact power of ten, which
    gives the double nearest to its decimal digits, as reading their text does. Numbers next to a
    half, beyond the exact powers or at a power of ten go through the text.
    """
    text = F.format_string(f"%.{digits}e", value).cast("double")
    size = F.abs(value)
    power = F.get(F.array(*[F.lit(t) for t in _TENS]), F.lit(digits) - F.floor(F.log10(size)).cast("int"))
    scaled = value * power
    left = F.abs(F.abs(scaled - F.rint(scaled)) - 0.5)
    # a product is off by 2 ** -53 of itself, far below this distance from the half
    plain = (left > 1e-3) & F.abs(scaled).between(float(10**digits), float(10 ** (digits + 1) - 1))
    usual = size.between(10.0 ** (digits - 21), float(10**digits))
    rounded = F.when(usual, F.when(plain, F.rint(scaled) / power).otherwise(text)).when(value.isNotNull(), text)
    return F.when(value == 0, value).otherwise(rounded)


def swa_series(series: DataFrame, windows: int = 12) -> DataFrame:
    """One row per series: ``points``, its points in order as an array of (ds, y), and the longest
    window that its forecasts have.

    Every forecast of the grid is read from it: the value for (s, w) at point i is the mean of the
    ``w`` values up to point i - s, NULL where one is missing. A mean's sum is that of the shorter
    window and one more value. A series is bounded by the calendar, so a row is small. The one
    requirement is that a series' points are together: an input partitioned or bucketed by
    ``unique_id`` isn't shuffled.
    """
    return (
        series.groupBy("unique_id").agg(F.sort_array(F.collect_list(F.struct("ds", "y"))).alias("points"))
        .withColumn("windows", F.lit(windows))
    )


def _value(place: Column) -> Column:
    return F.get("points", place)["y"]


def _means(place: Column, windows: int) -> list[Column]:
    """Means of the last 1 ... ``windows`` values at a point."""
    means, total = [], F.lit(0.0)
    for w in range(1, windows + 1):
        total = total + _value(place - (w - 1))
        means.append(total / F.when(F.col("windows") >= w, F.lit(float(w))))
    return means


def _by_shift(rows: DataFrame, windows: int, shifts: int) -> DataFrame:
    """Rows of ``swa_series`` to a row per point and s, with the windows as columns ``SWA_w<n>``."""
    points = (
        rows.select("unique_id", "points", "windows", F.posexplode("points.ds").alias("_i", "ds"))
        .select("unique_id", "ds", "points", "windows", "_i", _value(F.col("_i")).alias("y"))
        .select("*", _numbers(shifts).alias("s"))
    )
    means = _means(F.col("_i") - F.col("s"), windows)
    return points.select("ds", "unique_id", "y", "s", *[m.alias(f"SWA_w{w}") for w, m in enumerate(means, 1)])


def _numbers(top: int) -> Column:
    return F.explode(F.array(*[F.lit(n) for n in range(1, top + 1)]))


def swa_grid(series: DataFrame, windows: int = 12, shifts: int = 12, by_shift: bool = False) -> DataFrame:
    """For every point and every (s, w): mean of the ``w`` values that end ``s`` rows earlier,
    NULL unless all ``w`` exist. A row per point, s and w, or with ``by_shift`` a row per point and s
    that has the windows as columns ``SWA_w<n>``: groups of the latter are looked up once per ``s``
    instead of once per value.

    The grid is read from ``swa_series`` behind explodes of its points, ``s`` and ``w``, and all of it
    is one generated loop: the means of a point and ``s`` are built once, ahead of the loop over
    ``w``. The rows grow ``windows * shifts`` times here: an input that is small and not yet dealt
    out by series should be ``spread`` first, because adaptive execution would merge its partitions
    by the input's size.
    """
    grid = _by_shift(swa_series(series, windows), windows, shifts)
    if by_shift:
        return grid
    return (
        grid.select("unique_id", "ds", "y", "s", F.array(*window_columns(grid, "SWA")).alias("_means"))
        .select("unique_id", "ds", "y", "s", "_means", _numbers(windows).alias("w"))
        .select("ds", "unique_id", "y", "s", "w", F.get("_means", F.col("w") - 1).alias("SWA_value"))
    )


def window_columns(df: DataFrame, prefix: str) -> list[str]:
    """Columns ``<prefix>_w<n>`` of a table with a row per point and s, by n."""
    found = [(int(m[1]), c) for c in df.columns if (m := re.fullmatch(rf"{prefix}_w(\d+)", c))]
    return [c for _, c in sorted(found)]


def _error(actual: Column, predicted: Column, metric: str) -> Column:
    error = F.abs(actual - predicted)
    return error if _metric(metric) == "MAE" else F.try_divide(error, actual)


def forecast_errors(
    forecasts: DataFrame, actual: str = "y", predicted: str = "SWA_value"
) -> DataFrame:
    """Absolute error, and that error over the signed actual (NULL at 0): ``MAE`` and ``MAPE``, or
    ``MAE_w<n>`` and ``MAPE_w<n>`` of forecasts with the windows as columns."""
    columns = {"": predicted} if predicted in forecasts.columns else {
        c.removeprefix("SWA"): c for c in window_columns(forecasts, "SWA")
    }
    if not columns:
        raise ValueError(f"no column {predicted}")
    return forecasts.withColumns(
        {f"{m}{end}": _error(F.col(actual), F.col(c), m) for end, c in columns.items() for m in METRICS}
    )


def _tie_order(tie_order: Sequence[str]) -> list[str]:
    if sorted(tie_order) != ["s", "w"]:
        raise ValueError("tie_order must name s and w")
    return list(tie_order)


def _metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    return metric


def _window_means(results: DataFrame, start: str, end: str, metric: str) -> DataFrame:
    """Mean metric per series and (s, w) over a date range, of results in either layout."""
    inside = results.where(F.col("ds").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if _metric(metric) in results.columns:
        return inside.groupBy("unique_id", "s", "w").agg(F.avg(metric).alias("_mean"))
    columns = window_columns(results, metric)
    means = inside.groupBy("unique_id", "s").agg(*[F.avg(c).alias(c) for c in columns])
    return means.select("unique_id", "s", F.inline(by_window(columns, lambda c, n: F.col(c).alias("_mean"))))


def by_window(columns: Sequence[str], *values: Callable[[str, str], Column]) -> Column:
    """Array of a row per window: w, and what ``values`` make of its column and its number."""
    rows = [(c, c.rsplit("_w", 1)[1]) for c in columns]
    return F.array(*[F.struct(F.lit(int(n)).alias("w"), *[v(c, n) for v in values]) for c, n in rows])


def window_scores(
    results: DataFrame, start: str, end: str, metric: str = "MAE"
) -> DataFrame:
    """Mean metric per series and (s, w) over a date range."""
    return _window_means(results, start, end, metric).select(
        "unique_id", "s", "w",
        F.when(F.col("_mean").isNotNull(), significant(F.col("_mean"))).alias(f"{metric}_mean"),
    )


def _least(scores: DataFrame, score: str, tie_order: Sequence[str]) -> DataFrame:
    """The row of smallest score per series."""
    order = Window.partitionBy("unique_id").orderBy(score, *_tie_order(tie_order))
    return scores.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def best_window(
    results: DataFrame, start: str, end: str, metric: str = "MAE",
    tie_order: Sequence[str] = ("s", "w"),
) -> DataFrame:
    """The (s, w) of smallest mean metric per series; series without any metric are left out."""
    score = f"{metric}_mean"
    scores = window_scores(results, start, end, metric).where(F.col(score).isNotNull())
    return _least(scores, score, tie_order)


def best_window_forecast(
    results: DataFrame, start: str, target: str, metric: str = "MAE",
    tie_order: Sequence[str] = ("w", "s"), unique_ids: Sequence[str] = (),
) -> DataFrame:
    """Actual and predicted series of each series' best (s, w) up to the ``target`` month-end, from
    stored results.

    Pairs without a prediction at the target are out. The results are read twice, for the scores and
    for the rows of the chosen pairs; from a panel ``best_series_forecast`` needs neither.
    """
    target_ds = F.last_day(F.lit(target).cast("date"))
    rows = results.where(F.col("ds").between(F.lit(start).cast("date"), target_ds))
    if unique_ids:
        rows = rows.where(F.col("unique_id").isin(list(unique_ids)))
    missing = (F.col("ds") == target_ds) & F.col("SWA_value").isNull()
    pairs = rows.groupBy("unique_id", "s", "w").agg(
        F.avg(_metric(metric)).alias("_mean"), F.bool_or(missing).alias("_missing")
    )
    order = F.struct(significant(F.col("_mean")), *_tie_order(tie_order))
    chosen = (
        pairs.where(~F.col("_missing") & F.col("_mean").isNotNull())
        .groupBy("unique_id").agg(F.min_by(F.struct("s", "w"), order).alias("_best"))
        .select("unique_id", "_best.s", "_best.w")
    )
    return rows.join(chosen, ["unique_id", "s", "w"]).select(
        "unique_id", "ds", "s", "w", "y", "SWA_value", "MAE", "MAPE"
    )


def best_series_window(
    rows: DataFrame, start: str, end: str, metric: str = "MAE", tie_order: Sequence[str] = ("s", "w"),
    windows: int = 12, shifts: int = 12,
) -> DataFrame:
    """``best_window`` of the whole grid, from the rows of ``swa_series`` instead of its results."""
    return best_window(forecast_errors(_by_shift(rows, windows, shifts)), start, end, metric, tie_order)


def best_series_forecast(
    rows: DataFrame, start: str, target: str, metric: str = "MAE", tie_order: Sequence[str] = ("w", "s"),
    unique_ids: Sequence[str] = (), windows: int = 12, shifts: int = 12,
) -> DataFrame:
    """``best_window_forecast`` of the whole grid, from the rows of ``swa_series``: the values of the
    pair of least mean error are read from the series' points.

    The points go through the sums as the key of a group of their own, numbered 0 beside those of s, so
    they need no join and the sums stay in a hash table.
    """
    target_ds, first = F.last_day(F.lit(target).cast("date")), F.lit(start).cast("date")
    if unique_ids:
        rows = rows.where(F.col("unique_id").isin(list(unique_ids)))
    inside = F.col("ds").between(first, target_ds)
    at_target = F.col("_i") == F.col("_target")
    numbers = F.array(*[F.lit(n) for n in range(shifts + 1)])
    points = (
        rows.withColumn("_target", F.array_position("points.ds", target_ds) - 1)
        .select("unique_id", "points", "windows", "_target", F.posexplode("points.ds").alias("_i", "ds"))
        .where(inside | at_target | (F.col("_i") == 0))
        .select("*", inside.alias("_inside"), at_target.alias("_at"), _value(F.col("_i")).alias("y"))
        .select("*", F.explode(numbers).alias("s"))
        .where(F.when(F.col("s") == 0, F.col("_i") == 0).otherwise(F.col("_inside") | F.col("_at")))
    )
    names = [f"SWA_w{w}" for w in range(1, windows + 1)]
    # a number in a key would be normalized by a lambda, and the sums leave the generated loop
    text, kept = "array<struct<ds:date,y:string>>", "array<struct<ds:date,y:double>>"
    grid = points.select(
        "unique_id", "s", F.when(F.col("s") == 0, F.col("points").cast(text)).alias("points"),
        F.when(F.col("_inside") & (F.col("s") > 0), F.col("y")).alias("y"), (F.col("_at") & (F.col("s") > 0)).alias("_at"),
        *[m.alias(c) for c, m in zip(names, _means(F.col("_i") - F.col("s"), windows))],
    )
    sums = grid.groupBy("unique_id", "s", "points").agg(
        *[F.avg(_error(F.col("y"), F.col(c), metric)).alias(c) for c in names],
        *[F.max(F.col("_at") & F.col(c).isNull()).alias(f"_missing_{c}") for c in names],
    )
    known = [F.when(~F.coalesce(f"_missing_{c}", F.lit(False)), F.col(c)).alias(c) for c in names]
    sums = sums.select("unique_id", "s", "points", *known)
    least = F.least(*names, F.lit(None).cast("double"))
    means = F.inline(by_window(names, lambda c, n: F.col(c).alias("_mean")))
    # means that round to the least one are next to it
    near = F.col("_mean") <= F.col("_least") + F.abs("_least") * 10.0 ** (1 - SCORE_DIGITS)
    pairs = (
        sums.select("unique_id", "s", "points", least.alias("_least"), means)
        .where(near | (F.col("points").isNotNull() & (F.col("w") == 1)))
    )
    score = F.when(F.col("s") > 0, F.struct(significant(F.col("_mean")).alias("_mean"), *_tie_order(tie_order)))
    best = (
        pairs.groupBy("unique_id").agg(F.min(score).alias("_best"), F.max("points").alias("points"))
        .where(F.col("_best").isNotNull())
        .select("unique_id", F.col("points").cast(kept).alias("points"), "_best.s", "_best.w", F.lit(windows).alias("windows"))
        .select("*", F.posexplode("points.ds").alias("_i", "ds")).where(inside)
    )
    value = F.get(F.array(*_means(F.col("_i") - F.col("s"), windows)), F.col("w") - 1)
    return forecast_errors(
        best.select("unique_id", "ds", "s", "w", _value(F.col("_i")).alias("y"), value.alias("SWA_value"))
    )


def actual_vs_forecast_wide(best: DataFrame, unique_ids: Sequence[str]) -> DataFrame:
    """One row per month with a prediction and an actual column for each listed series."""
    return (
        best.where(F.col("unique_id").isin(list(unique_ids)))
        .groupBy(F.date_format("ds", "yyyy-MM").alias("month"))
        .pivot("unique_id", list(unique_ids))
        .agg(F.max("SWA_value").alias("SWA_value"), F.max("y").alias("y"))
        .orderBy("month")
    )


def reshape_forecast_columns(
    wide: DataFrame, data_type: str = "true_and_pred", by_shift: bool = False
) -> DataFrame:
    """Wide ``SWA_s<n>_w<n>`` result columns of one data type to the long result layout with errors,
    or with ``by_shift`` to a row per point and s with the windows as columns, as ``swa_grid`` has it.

    The columns form one array, whose places are the pairs of their names, so each row is exploded
    where it is. A missing actual stays NULL, a row gives all its pairs, and rows that repeat a point
    are reshaped one by one.
    """
    found = [(c, re.fullmatch(r"SWA_s(\d+)_w(\d+)", c)) for c in wide.columns]
    pairs = {(int(m[1]), int(m[2])): c for c, m in found if m}
    rows = wide.where(F.col("data_type") == data_type)
    if by_shift:
        shifts, windows = (sorted({p[k] for p in pairs}) for k in (0, 1))
        if len(pairs) != len(shifts) * len(windows):
            raise ValueError("a row per point and s needs a column for every pair of s and w")
        values = F.array(*[F.array(*[pairs[s, w] for w in windows]) for s in shifts])
        rows = rows.select("unique_id", "ds", "y", values.alias("_values"))
        rows = rows.select("*", F.posexplode(F.array(*[F.lit(s) for s in shifts])).alias("_i", "s"))
        rows = rows.select("unique_id", "ds", "y", "s", F.get("_values", F.col("_i")).alias("_values"))
        return forecast_errors(
            rows.select(
                "unique_id", "ds", "y", "s",
                *[F.get("_values", F.lit(i)).alias(f"SWA_w{w}") for i, w in enumerate(windows)],
            )
        )
    names = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(w).alias("w")) for s, w in pairs])
    long = (
        rows.select("unique_id", "ds", "y", F.array(*pairs.values()).alias("_values"))
        .select("unique_id", "ds", "y", "_values", F.posexplode(names).alias("_i", "_p"))
    )
    return forecast_errors(
        long.select("unique_id", "ds", "y", "_p.s", "_p.w", F.get("_values", F.col("_i")).alias("SWA_value"))
    )


def widen_forecast_columns(rows: DataFrame, windows: int = 12, shifts: int = 12) -> DataFrame:
    """Rows of ``swa_series`` to points with one ``SWA_s<n>_w<n>`` column per pair.

    The filter lets every row through. It keeps Spark from copying all the columns' expressions into a
    reader of the table: a generated loop with all of them is a method too large to be compiled, and
    what is in the loop behind them runs uncompiled too.
    """
    points = rows.select("unique_id", "points", "windows", F.posexplode("points.ds").alias("_i", "ds"))
    values = [_value(F.col("_i") - n) for n in range(1, shifts + windows)]
    widths = [F.when(F.col("windows") >= w, F.lit(float(w))) for w in range(1, windows + 1)]
    forecasts = []
    for s in range(1, shifts + 1):
        total = F.lit(0.0)
        for w in range(1, windows + 1):
            total = total + values[s + w - 2]
            forecasts.append((total / widths[w - 1]).alias(f"SWA_s{s}_w{w}"))
    wide = points.select(
        "unique_id", "ds", _value(F.col("_i")).alias("y"), *forecasts, F.lit("true_and_pred").alias("data_type"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return wide.where("_row >= 0").drop("_row")
