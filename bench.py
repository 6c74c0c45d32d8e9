"""Headline queries, timed; prints one JSON line.

``BENCH_SF_DIR`` picks the tables (default /root/testdata/sf0.1), ``BENCH_CPUS`` the
local threads (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from seriespan import registry  # noqa: E402

HEADLINE = [
    "hysteresis_runs", "band_runs", "hold_asof", "role_grid", "derivative", "window_extreme", "local_peak",
    "sampling_gaps", "channel_stats", "mesh_2d", "rollup_continuous", "rollup_enum", "unit_convert", "exclusion_filter",
    "phase_segments", "gear_detection", "step_response", "plausibility", "identity_layers", "concatenated_timeline",
    "index_plan", "type_inference", "detector_lean_under_load", "triage_table", "native_samples", "csv_dialect", "csv_series",
    "enum_encode_decode",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    wanted = sys.argv[1:] or HEADLINE
    for name in ("out_of_range", "hysteresis_runs", "mesh_2d"):  # start the JVM's workers and compiler
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
