"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEATS (default 2 timed runs after one warm-up, median reported).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))

HEADLINE = [
    "agg1_item_summary",
    "agg3_daily_demand",
    "agg4_running_totals",
    "agg5_tumbling_stats",
    "agg11_quality_metrics",
    "agg18_consolidated_orders",
    "str2_hopping_stats_batch",
    "str3_sessions_batch",
    "win1_sliding_per_event",
    "win3_rolling_features",
    "win6_running_stock",
    "win12_ordered_split",
    "fc2_trend",
    "fc6_ensemble_bounds",
    "fc7_baseline",
    "uq2_bootstrap_mean",
    "uq3_monte_carlo",
    "inv1_5_stock_targets",
    "inv6_9_expected_costs",
    "inv13_recommendations",
    "inv17_policy",
    "ord1_validation",
    "ord4_priority_batches",
    "grf2_association",
    "grf3_top_partners",
    "join12_interval_join",
    "prv6_rare_combinations",
    "prv9_private_release",
    "str1_tumbling",
    "str7_live_totals",
]


def main() -> None:
    from replenish.plans.catalog import REGISTRY
    from replenish.session import build_session

    spark = build_session(
        "replenish-bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for key in HEADLINE:
        taken = []
        for _ in range(REPEATS + 1):
            start = time.perf_counter()
            REGISTRY[key].run(spark, FOLDER).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[key] = round(statistics.median(taken[1:] or taken), 3)
    scale = re.search(r"sf([0-9.]+)", FOLDER)
    print(
        json.dumps(
            {
                "metric": "replenish_headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
