"""Seconds per headline query at one data size; prints one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the local cores. Each query runs
once to warm up code generation and file caches, then the better of two runs counts. A query whose first
run takes over ``LONG`` seconds is not run again.
"""

from __future__ import annotations

import json
import os
import time

from loadcast.catalogue import QUERIES
from loadcast.session import build_session

LONG = 20

HEADLINE = [
    "flagship", "newest_n", "ingest_records", "resample_mean", "detect_frequency", "row_position",
    "calendar", "rolling_mean_std", "rolling_median", "ewma", "ffill", "features_basic", "features_compact",
    "features_comprehensive", "split_temporal", "split_random", "folds", "metrics_point", "crps",
    "fairness_summary", "leaderboard", "describe", "exact_quantiles", "scale_robust", "simple_ols",
    "grid_search", "feature_selection", "random_forest", "gradient_boosting", "quantile_boosting",
    "ensemble_forecast", "bfill", "forecast_naive", "forecast_linear", "forecast_two_features",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("loadcast-bench", f"local[{cpus}]", spark_ui_enabled="false",
                          spark_driver_memory="16g", spark_ui_showConsoleProgress="false",
                          **{"spark_sql_shuffle_partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            if runs and runs[0] > LONG:
                break
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs[1:] or runs), 3)
    print(json.dumps({"metric": "total query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
