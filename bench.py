"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidepanel.plans.catalog import REGISTRY  # noqa: E402
from tidepanel.session import configured  # noqa: E402

HEADLINE = [
    "daily_panel",
    "features",
    "labels",
    "features_supplier",
    "labels_supplier",
    "core_distributions_supplier",
    "horizon_agreement",
    "tagged_days",
    "pooled_effects",
    "difficulty_auc",
    "baseline_ranking_metrics",
    "baseline_lead_times",
    "scenario_scores",
    "incidents",
    "injection_flags_documents",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        configured(SparkSession.builder)
        .master(f"local[{cpus}]")
        .appName("tidepanel-bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)) if cpus.isdigit() else "16")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["panel_structure"](spark, sf_dir).collect()  # start the JVM and its compiler
    timings = {}
    for name in HEADLINE:
        started = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
