"""Benchmark the headline queries.

Runs each query in HEADLINE on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line.  Each query is materialised with a
no-op write (the whole result is computed, nothing is collected to the driver); the
time is the median of ``$BENCH_REPEAT`` runs (default 3) after one warm-up run.
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from loomspark.session import build_session  # noqa: E402
from loomspark.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "task_performance", "health_rollup", "run_history", "jobs_all_dags", "latest_run",
    "first_failed", "log_tail", "log_summary",
    "reconcile", "reconcile_summary", "compare_folders", "compare_results", "row_diff",
    "schema_audit", "audit_summary", "leaf_profile",
    "lineage_edges", "task_depth", "trace",
    "sql_flags", "json_extract", "expand_glossary", "lint_sources",
    "sql_d1_scan_filter", "sql_d2_joins", "sql_d6_groupby", "sql_d8_windows", "sql_d19_q1", "sql_d19_q5",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = build_session(f"local[{cpus}]", app="loomspark-bench", shuffle_partitions=max(8, cpus * 2),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    times, failed = {}, {}
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        runs = []
        try:
            for i in range(repeat + 1):
                t0 = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                if i:
                    runs.append(time.perf_counter() - t0)
            times[name] = round(statistics.median(runs), 3)
        except Exception as exc:  # noqa: BLE001 — report the failure, keep measuring the rest
            failed[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "repeat": repeat}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
