"""Rolling-origin backtest of baseline forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODELS = ("Naive", "SeasonalNaive", "WindowAverage", "SeasonalWindowAverage")


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)


def baseline_backtest(
    panel: DataFrame, horizon: int = 4, step: int = 9, folds: int = 5,
    season: int = 12, window: int = 6, swa_window: int = 2, swa_season: int = 2,
) -> DataFrame:
    """Forecasts of four baseline models for every fold and step ahead of every series.

    A series is one calendar-sized array, so after the single shuffle by series each fold is
    array arithmetic. A model is NULL where the fold's history is too short for it.
    """
    series = panel.groupBy("unique_id").agg(
        F.array_sort(F.collect_list(F.struct("ds", "y"))).alias("points")
    )
    test_size = horizon + step * (folds - 1)
    origins = (
        series.select("unique_id", "points", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
        .withColumn("cut", F.size("points") - test_size + F.col("fold") * step)
        .where(F.col("cut") >= 1)
        .withColumn("values", F.transform("points", lambda p: p["y"]))
        .withColumn("cutoff", F.get("points", F.col("cut") - 1)["ds"])
        .withColumn(
            "window_mean",
            F.when(
                F.col("cut") >= window,
                _mean(F.slice("values", F.greatest(F.col("cut") - window + 1, F.lit(1)), window)),
            ),
        )
    )
    ahead = origins.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))

    def seasonal(length: int, back: int) -> Column:
        # 0-based position of the same season, ``back`` seasons before the last one
        position = F.col("cut") - length + (F.col("h") - 1) % length - back * length
        return F.get("values", position)

    lags = F.array(*[seasonal(swa_season, r) for r in range(swa_window)])
    point = F.get("points", F.col("cut") + F.col("h") - 1)
    return ahead.select(
        "unique_id", "fold", "cutoff", "h", point["ds"].alias("ds"), point["y"].alias("y"),
        F.get("values", F.col("cut") - 1).alias("Naive"),
        F.when(F.col("cut") >= season, seasonal(season, 0)).alias("SeasonalNaive"),
        F.col("window_mean").alias("WindowAverage"),
        F.when(F.col("cut") >= swa_window * swa_season, _mean(lags)).alias("SeasonalWindowAverage"),
    )


def fold_rmse(backtest: DataFrame) -> DataFrame:
    """RMSE per series, fold and model."""
    wide = backtest.groupBy("unique_id", "fold").agg(
        *[F.sqrt(F.avg(F.pow(F.col(m) - F.col("y"), 2))).alias(m) for m in MODELS]
    )
    return wide.unpivot(["unique_id", "fold"], list(MODELS), "model", "rmse")


def backtest_rmse(backtest: DataFrame) -> DataFrame:
    """RMSE per series and model, averaged over the folds."""
    return fold_rmse(backtest).groupBy("unique_id", "model").agg(F.avg("rmse").alias("mean_rmse"))
