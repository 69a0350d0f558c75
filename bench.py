"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. The tables come as single row groups,
which one task would read alone, so they are first stored in several files, as large tables are; this
is not timed. Every query runs twice over whole tables and writes all of its rows to a sink that discards them. `queries` holds the second times,
`first_run` those that include code generation and warm-up, and `pixel_dataset_frames_per_sec` the rate of one
dataset build from pixels, which is not in the total; both include building the plan and any
table the query stores on the way.
"""

from __future__ import annotations

import json
import os
import re
import time

from plumewatch.plans import catalog, views
from plumewatch.session import build_session, scratch_path

TABLES = ("events", "orders", "lineitem", "documents", "embeddings")

HEADLINE = (
    "any_tile_held_out",
    "K5_rule_leaderboard",
    "G5_threshold_sweep",
    "G6_capture_result",
    "W1_temporal_confirmation",
    "W2_run_lengths",
    "W6_curve_points",
    "S3_patch_build",
    "S1_negative_windows",
    "J1_window_box_overlap",
    "J2_untouched_windows",
    "J3_tile_box_coverage",
    "C8_route_and_errors",
    "C10_readable_text",
    "C17_policy_audit",
    "W3_hourly_alert_cap",
    "S6_epoch_order",
    "J10_fleet_verdict",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    stored = scratch_path(spark, "bench-tables")
    for table in TABLES:
        spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").repartition(
            max(1, spark.sparkContext.defaultParallelism)).write.parquet(f"{stored}/{table}.parquet")
    catalog.QUERIES["G13_most_common"](spark, stored).collect()  # starts the session
    first, times = {}, {}
    for name in HEADLINE:
        for seen in (first, times):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, stored).write.format("noop").mode("overwrite").save()
            seen[name] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    catalog.QUERIES["A8_pixel_dataset"](spark, stored).write.format("noop").mode("overwrite").save()
    rate = views.raster_frames(spark, stored).count() / (time.perf_counter() - start)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "first_run": first, "pixel_dataset_frames_per_sec": round(rate, 1),
        "sf": float(found.group(1)) if found else sf_dir}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
