"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "gap_inventory", "conservation", "describe_lengths", "overlap_pairs", "zone_overlaps",
    "candidate_windows", "excluded_by_rule", "normalized_entities", "pair_summary",
    "junction_support", "coverage_profile", "depth_outliers", "mirror_compare", "anchor_hits",
    "window_sequence", "reference_identity", "probe_trios", "run_catalog", "step_log_order",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from locusframe.queries import queries

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    names = sys.argv[1:] or HEADLINE
    registered["type_counts"](spark, folder).collect()  # start the JVM and Python side
    seconds = {}
    for name in names:
        began = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
