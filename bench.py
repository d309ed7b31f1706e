"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from shelfcast.plans.catalog import queries
from shelfcast.session import build_session

HEADLINES = [
    "period_totals", "topk_item_series", "topk_and_others", "avg_by_weekday",
    "material_mix_series", "color_mix_series", "income_vs_expense", "order_value_histogram",
    "income_by_country", "unique_customers_series", "rolling_mean", "net_outgoing",
    "supply_spend_by_supplier", "calendar_fill", "conform_erp_lines", "explode_order_items",
    "unpivot_month_columns", "profile_columns", "topn_by_count", "histogram", "hierarchy_rollup",
    "extend_series", "swa_grid", "best_window", "best_window_forecast", "reshape_forecast_columns",
    "baseline_backtest", "backtest_rmse", "time_index_split", "auto_ar_forecast",
    "seasonal_ar_forecast", "unique_customers_rollup", "load_pretty_envelope", "backtest_stored",
]


def run(name: str, spark, sf_dir: str) -> float:
    begun = time.perf_counter()
    queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "shelfcast-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus)) if cpus.isdigit() else "16",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run("period_totals", spark, sf_dir)  # start the workers before timing
    seconds = {name: round(run(name, spark, sf_dir), 3) for name in HEADLINES}
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
