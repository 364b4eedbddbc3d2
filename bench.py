"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder and ``BENCH_CPUS`` the cores. Each query
runs once to warm up and is then timed to its last row, the best of two runs;
the slow sweeps run once.
"""

from __future__ import annotations

import json
import os
import sys
import time

from ledgerloom.plans.registry import QUERIES
from ledgerloom.session import build_session

HEADLINE = [
    "customer_features",
    "rfm",
    "invoice_gaps",
    "extended_stats",
    "feature_histograms",
    "retail_kpis",
    "revenue_by_month",
    "revenue_by_country",
    "product_concentration",
    "revenue_by_sector",
    "closed_win_rate",
    "pipeline_pivot",
    "attrition_by_dimension",
    "daily_sales_filled",
    "rolling_sales",
    "forecast_series",
    "train_test_split",
    "regression_comparison",
    "segment_customers",
    "silhouette",
    "density_clusters",
    "density_silhouette",
    "best_k",
    "basket_items",
    "association_rules",
]

# Sweeps of ten starts for each k, timed once without a warm-up.
SLOW = ["kmeans_sweep", "kmeans_sweep_extended"]


def run(spark, name: str, folder: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": cores,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in sys.argv[1:] or [*HEADLINE, *SLOW]:
        if name in SLOW:
            seconds[name] = round(run(spark, name, folder), 3)
            continue
        run(spark, name, folder)
        seconds[name] = round(min(run(spark, name, folder) for _ in range(2)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": int(cores),
                "shuffle_partitions": int(cores),
                "state": "warm",
            }
        )
    )


if __name__ == "__main__":
    main()
