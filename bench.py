"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

The raw bookings are first written once as the source file (the original
reads a CSV; here they are derived from the TPC-H style tables), timed as
``write_raw_source``.  The clean bookings are then written once as the partitioned Parquet table
(the step the original did by loading its relational table), timed as
``ingest_clean_table``; the two searchable collections (documents with
TF-IDF term weights, and the idf tables) are then stored once, timed as
``build_text_indexes`` (the original's embedding/vector-store load); the
shared insight aggregate is stored once as well, timed as
``precompute_insights`` (the original's precomputed-insights table).  Every query then runs to completion with
the ``noop`` sink (full execution, nothing collected to the driver).

Queries that build and refresh a store of their own are reported in ``refresh``, not in the sum.

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from staylens.plans import context  # noqa: E402
from staylens.plans.catalog import queries  # noqa: E402
from staylens.plans.session import get_spark  # noqa: E402


# these write a store of their own before they read it, so they are reported beside the queries
REFRESH = {"u3_search_after_update", "a14_insights_after_update", "s14_keyed_upsert", "u4_streamed_search", "s2_clean_csv",
           "s3_clean_table", "s4_table_lookups", "s7_upsert_insight", "s8_get_insight", "s9_get_all_insights", "s10_select_insights",
           "s11_append_query_log", "e1_dense_search", "e8_answer_log", "s13_collections", "s17_summary_json", "a13_payload_fields", "u5_streaming_revenue"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    only = [a for a in sys.argv[1:] if not a.startswith("-")]
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = get_spark()

    # warm-up (JIT, session start) on the smallest tables, not timed
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.format("noop").mode("overwrite").save()

    t0 = time.perf_counter()
    context.materialize_raw(spark, sf_dir, "bench_raw_bookings")
    raw_write = time.perf_counter() - t0
    t0 = time.perf_counter()
    context.materialize_bookings(spark, sf_dir, "bench_bookings_table")
    ingest = time.perf_counter() - t0
    t0 = time.perf_counter()
    context.materialize_insight_cube(spark, sf_dir, "bench_insight_cube")
    cube_time = time.perf_counter() - t0
    t0 = time.perf_counter()
    context.materialize_collections(spark, sf_dir, "bench_collections")
    index_build = time.perf_counter() - t0

    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name, fn in queries().items():
        if only and not any(o in name for o in only):
            continue
        t = time.perf_counter()
        try:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t, 4)
        except Exception as e:  # noqa: BLE001 - report, keep measuring the rest
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    refresh = {name: times.pop(name) for name in list(times) if name in REFRESH}
    total = round(sum(times.values()), 4)
    out = {
        "metric": "sum_of_query_seconds",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "write_raw_source": round(raw_write, 4),
        "ingest_clean_table": round(ingest, 4),
        "precompute_insights": round(cube_time, 4),
        "build_text_indexes": round(index_build, 4),
        "refresh": refresh,
        "n_queries": len(times),
        "mean_query_seconds": round(total / len(times), 4) if times else None,
        "cpus": int(os.environ.get("BENCH_CPUS", "8")),
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
