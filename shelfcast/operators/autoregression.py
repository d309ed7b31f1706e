"""Automatic choice among closed-form autoregressive forecasts, for all series at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SLOPE = 0.999
MIN_POINTS = 5
PERFECT_FIT = 1e-12


def _aicc(sse: Column, n: Column, parameters: int) -> Column:
    k = float(parameters)
    correction = F.try_divide(F.lit(2 * k * (k + 1)), n - k - 1)
    return n * F.log(F.try_divide(sse, n)) + 2 * k + correction


def auto_ar_forecast(panel: DataFrame, test_part: str = "test") -> DataFrame:
    """Fit mean, drift, AR(1) and AR(1)-on-differences per series on the train part, keep the one
    of smallest AICc and predict as many steps as the test part has months.

    ``panel`` is the output of ``time_index_split``. The lags, the least-squares sums and the last
    values come from one partitioning by series; a series is one row from there on. The number of
    steps is asked for with a value of ``y``, so its subquery reads the shuffle of the panel.
    """
    index = F.when(F.col("part") == test_part, F.col("time_idx"))
    steps = panel.agg(
        F.struct((F.max(index) - F.min(index) + 1).alias("n"), F.max("y").alias("top"))
    ).scalar()["n"]
    by_series = Window.partitionBy("unique_id").orderBy("time_idx")
    train = (
        panel.where(F.col("part") != test_part)
        .select("unique_id", "time_idx", "y", F.lag("y").over(by_series).alias("y1"))
        .select("*", (F.col("y") - F.col("y1")).alias("d"))
        .select("*", F.lag("d").over(by_series).alias("d1"))
    )
    # every candidate is judged on the points that all of them can explain
    y, y1, d, d1 = (
        F.when(F.col("d1").isNotNull(), F.col(c)) for c in ("y", "y1", "d", "d1")
    )
    fits = train.groupBy("unique_id").agg(
        F.count("d1").cast("double").alias("n"),
        F.avg(y).alias("mean_y"), F.avg(y1).alias("mean_y1"),
        F.avg(d).alias("mean_d"), F.avg(d1).alias("mean_d1"),
        F.regr_syy(y, y1).alias("yy"), F.regr_sxx(y, y1).alias("xx"), F.regr_sxy(y, y1).alias("xy"),
        F.regr_syy(d, d1).alias("dd"), F.regr_sxx(d, d1).alias("ee"), F.regr_sxy(d, d1).alias("de"),
        F.sum(y * y).alias("scale"),
        F.max_by("y", "time_idx").alias("last_y"), F.max_by("d", "time_idx").alias("last_d"),
        F.max("time_idx").alias("last_idx"),
    )

    def slope(sxy: str, sxx: str) -> Column:
        raw = F.try_divide(F.col(sxy), F.col(sxx))
        clamped = F.greatest(F.least(raw, F.lit(MAX_SLOPE)), F.lit(-MAX_SLOPE))
        return F.when(raw.isNotNull(), clamped)

    def error(syy: str, sxy: str, sxx: str, b: str) -> Column:
        return F.col(syy) - 2 * F.col(b) * F.col(sxy) + F.col(b) * F.col(b) * F.col(sxx)

    usable = F.col("n") >= MIN_POINTS
    solved = fits.withColumns(
        {"b": F.when(usable, slope("xy", "xx")), "c": F.when(usable, slope("de", "ee"))}
    )
    candidates = [
        ("mean", F.col("yy"), 2),
        ("drift", F.col("dd"), 2),
        ("ar1", error("yy", "xy", "xx", "b"), 3),
        ("diff_ar1", error("dd", "de", "ee", "c"), 3),
    ]

    def ranked(order: int, name: str, sse: Column, parameters: int) -> Column:
        # a perfect fit has no finite AICc: the simplest such model goes first
        exact = sse <= F.greatest(F.col("scale"), F.lit(1.0)) * PERFECT_FIT
        score = F.when(exact, F.lit(float("-inf"))).otherwise(_aicc(sse, F.col("n"), parameters))
        entry = F.struct(score.alias("aicc"), F.lit(order).alias("order"), F.lit(name).alias("model"))
        return F.when(usable & sse.isNotNull(), entry)

    chosen = solved.withColumn(
        "best",
        F.array_min(F.array_compact(F.array(*[ranked(i, *c) for i, c in enumerate(candidates)]))),
    )
    rows = chosen.withColumn("steps", steps).select(
        "*", F.explode(F.sequence(F.lit(1), F.col("steps").cast("int"))).alias("h")
    )
    h = F.col("h").cast("double")
    level = (F.col("mean_y") - F.col("b") * F.col("mean_y1")) / (1 - F.col("b"))
    trend = (F.col("mean_d") - F.col("c") * F.col("mean_d1")) / (1 - F.col("c"))
    decay = F.col("c") * (1 - F.pow("c", h)) / (1 - F.col("c"))
    model = F.col("best.model")
    forecast = (
        F.when(model == "mean", F.col("mean_y"))
        .when(model == "drift", F.col("last_y") + h * F.col("mean_d"))
        .when(model == "ar1", level + F.pow("b", h) * (F.col("last_y") - level))
        .when(model == "diff_ar1", F.col("last_y") + h * trend + (F.col("last_d") - trend) * decay)
    )
    return rows.select(
        "unique_id", (F.col("last_idx") + F.col("h")).alias("time_idx"), "h",
        model.alias("model"), forecast.alias("forecast"),
    )


SEASON = 12
MAX_ORDER = 12
#: Least points after the seasonal difference, and the share of the variance that counts as none.
SEASONAL_POINTS = 20
NO_VARIANCE = 1e-9


def _once(df: DataFrame, keep: list[str], **values: Column) -> DataFrame:
    """Columns ``keep`` and new ones, each computed once per row.

    A projection may be copied into every place that names it, lambdas included, where it would be
    computed for each element; the explode of a one-element array can't be.
    """
    made = F.struct(*[v.alias(name) for name, v in values.items()])
    return df.select(*keep, F.inline(F.array(made)))


def _seasonal_forms(series: DataFrame, keys: list[str], season: int) -> DataFrame:
    """``keys`` with both forms of the values ``past``, ``x0`` and ``x1``, and their means. Too short a
    series has NULL for them, and so for all that follows."""
    rows = _once(series, keys, late=F.slice("past", season + 1, F.greatest(F.size("past") - season, F.lit(0))))
    enough = (F.size("late") >= SEASONAL_POINTS) & F.col("unique_id").isNotNull()
    seasonal = F.zip_with("late", F.slice("past", F.lit(1), F.size("late")), lambda now, before: now - before)
    rows = _once(rows, keys, x0=F.when(enough, F.col("late")), x1=F.when(enough, seasonal))
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda total, v: total + v) / F.size(x)
    return _once(rows, [*keys, "x0", "x1"], mean0=mean("x0"), mean1=mean("x1"))


def _autocovariances(series: DataFrame, order: int, season: int) -> DataFrame:
    """``series`` (unique_id, last_idx, past) with ``c0`` and ``c1``: for both forms those of lags 0 ...
    ``order``, each over the number of all points.

    A point is a row and the products with its followers are sums, so they are made in generated code.
    The values go along as the key of a group of their own, as text: numbers in a key would be
    normalized by a lambda and the sums leave the generated loop.
    """
    rows = _seasonal_forms(series, ["unique_id", "last_idx", "past"], season)
    centred = lambda x, mean: F.transform(x, lambda v: v - F.col(mean))
    rows = _once(rows, ["unique_id", "last_idx", "past"], z0=centred("x0", "mean0"), z1=centred("x1", "mean1"))
    points = rows.select("*", F.posexplode("past").alias("_i", "_y")).select(
        "*", F.explode(F.when(F.col("_i") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("_group")
    )
    own = {d: F.when(F.col("_group") == 1, F.get(f"z{d}", F.col("_i"))) for d in (0, 1)}
    products = {(d, k): own[d] * F.get(f"z{d}", F.col("_i") + k) for d in (0, 1) for k in range(order + 1)}
    points = points.select(
        "unique_id", "last_idx", "_group", F.when(F.col("_group") == 0, F.col("past").cast("array<string>")).alias("_past"),
        F.size("z0").alias("_n"), *[c.alias(f"_{d}_{k}") for (d, k), c in products.items()],
    )
    sums = points.groupBy("unique_id", "last_idx", "_group", "_past", "_n").agg(
        *[F.sum(f"_{d}_{k}").alias(f"_{d}_{k}") for d, k in products]
    )
    both = {d: F.when(F.col("_0_0").isNotNull(), F.array(*[F.col(f"_{d}_{k}") / F.col("_n") for k in range(order + 1)])) for d in (0, 1)}
    found = sums.select("unique_id", "last_idx", "_past", both[0].alias("c0"), both[1].alias("c1"))
    return found.groupBy("unique_id", "last_idx").agg(
        F.max("_past").cast("array<double>").alias("past"), F.max("c0").alias("c0"), F.max("c1").alias("c1")
    )


def _levinson_durbin(covariances: str, order: int) -> Column:
    """Models (p, v, phi) of orders 0 ... ``order``: coefficients and innovation variance. The
    recursion ends where no variance is left."""
    c = F.col(covariances)
    first = F.struct(
        F.lit(0).alias("p"), F.get(c, F.lit(0)).alias("v"), F.array().cast("array<double>").alias("phi")
    )
    model = "array<struct<p: int, v: double, phi: array<double>>>"

    def step(models: Column, k: Column) -> Column:
        def grown(last: Column) -> Column:
            ahead = F.aggregate(
                F.zip_with(last["phi"], F.reverse(F.slice(c, F.lit(2), k - 1)), lambda f, x: f * x),
                F.lit(0.0), lambda total, x: total + x,
            )

            def next_model(r: Column) -> Column:
                phi = F.zip_with(last["phi"], F.reverse(last["phi"]), lambda f, b: f - r * b)
                return F.struct(
                    k.cast("int").alias("p"), (last["v"] * (1 - r * r)).alias("v"), F.concat(phi, F.array(r)).alias("phi")
                )

            # the lambda of a one-element array computes the reflection once
            reflection = F.array((F.get(c, k) - ahead) / last["v"])
            left = last["v"] > F.get(c, F.lit(0)) * NO_VARIANCE
            return F.when(left & (last["p"] == k - 1), F.get(F.transform(reflection, next_model), F.lit(0)))

        more = F.transform(F.slice(models, -1, 1), grown)
        return F.concat(models, F.array_compact(more)).cast(model)

    return F.aggregate(F.sequence(F.lit(1), F.lit(order)), F.array(first).cast(model), step)


def seasonal_ar_forecast(
    panel: DataFrame, test_part: str = "test", season: int = SEASON, max_order: int = MAX_ORDER
) -> DataFrame:
    """Fit AR(0) ... AR(``max_order``) per series on the train part, to the values and to their
    differences over a ``season``, and forecast by the model of smallest AICc as many steps as the
    test part has months.

    ``panel`` is the output of ``time_index_split``. Both forms are judged on the points that have a
    value a season earlier, so their errors are errors of the same values. Coefficients come from
    autocovariances by the Levinson-Durbin recursion, which gives all orders in one pass over them.
    Scores are compared at ten significant digits; ties go to the plain form, then to the lower
    order. Without variance the mean (or the last season) goes on. Series with fewer than
    ``SEASONAL_POINTS`` such points have NULL forecasts.

    A series is one row of a calendar-sized array, and all of it is array work in that row, the choice
    among the models of both forms included: one shuffle by series, no join, no row per model.
    """
    index = F.when(F.col("part") == test_part, F.col("time_idx"))
    steps = panel.agg(F.struct((F.max(index) - F.min(index) + 1).alias("n"), F.max("y").alias("top"))).scalar()["n"]
    series = panel.where(F.col("part") != test_part).groupBy("unique_id").agg(
        F.sort_array(F.collect_list(F.struct("time_idx", "y"))).alias("points"), F.max("time_idx").alias("last_idx")
    )
    series = _once(series, ["unique_id", "last_idx"], past=F.col("points.y"))
    rows = _autocovariances(series, max_order, season)
    rows = _seasonal_forms(rows, ["unique_id", "last_idx", "past", "c0", "c1"], season).withColumn("_steps", steps)
    keys = ["unique_id", "last_idx", "past", "_steps", "x0", "x1", "mean0", "mean1"]
    rows = _once(rows, keys, **{f"models{d}": F.when(F.col(f"c{d}").isNotNull(), _levinson_durbin(f"c{d}", max_order)) for d in (0, 1)})

    def scored(d: int) -> Column:
        n = F.size(f"x{d}").cast("double")

        def score(m: Column) -> Column:
            k = m["p"] + 2.0
            aicc = n * F.log(m["v"]) + 2 * k + F.try_divide(2 * k * (k + 1), n - k - 1)
            value = F.when(m["v"] > 0, F.format_string("%.9e", aicc).cast("double")).otherwise(F.lit(float("-inf")))
            return F.struct(value.alias("score"), F.lit(d).alias("d"), m["p"].alias("p"), m["phi"].alias("phi"))

        return F.transform(F.filter(f"models{d}", lambda m: m["p"] < F.size(f"x{d}") - 3), score)

    rows = _once(rows, keys, m=F.array_min(F.concat(scored(0), scored(1))))
    of_form = lambda name: F.when(F.col("m.d") == 0, F.col(f"{name}0")).when(F.col("m.d") == 1, F.col(f"{name}1"))
    best = _once(
        rows, ["unique_id", "last_idx", "past", "_steps"], d=F.col("m.d"), p=F.col("m.p"), phi=F.col("m.phi"),
        x=of_form("x"), mean=of_form("mean"),
    )

    def ahead(so_far: Column, _: Column) -> Column:
        recent = F.reverse(F.slice(so_far, F.size(so_far) - F.col("p") + 1, F.col("p")))
        terms = F.zip_with("phi", recent, lambda f, v: f * (v - F.col("mean")))
        return F.concat(so_far, F.array(F.aggregate(terms, F.col("mean"), lambda total, t: total + t)))

    horizon = F.sequence(F.lit(1), F.col("_steps").cast("int"))
    best = _once(best, ["unique_id", "last_idx", "past", "_steps", "d", "p", "x"], z=F.aggregate(horizon, F.col("x"), ahead))

    def season_added(so_far: Column, h: Column) -> Column:
        earlier = F.get(so_far, F.size(so_far) - season)
        return F.concat(so_far, F.array(F.get(F.col("z"), F.size("x") + h - 1) + F.when(F.col("d") == 1, earlier).otherwise(0.0)))

    best = _once(
        best, ["unique_id", "last_idx", "d", "p", "_steps", "past"], values=F.aggregate(horizon, F.col("past"), season_added)
    )
    return (
        best.select(
            "unique_id", "last_idx", "d", "p", F.slice("values", F.size("past") + 1, F.col("_steps").cast("int")).alias("values"),
            F.explode(F.sequence(F.lit(1), F.col("_steps").cast("int"))).alias("h"),
        )
        .select(
            "unique_id", (F.col("last_idx") + F.col("h")).cast("int").alias("time_idx"), "h",
            F.when(F.col("d") == 1, "seasonal").when(F.col("d") == 0, "plain").alias("form"), F.col("p").alias("order"),
            F.when(F.col("d").isNotNull(), F.get("values", F.col("h") - 1)).alias("forecast"),
        )
    )
