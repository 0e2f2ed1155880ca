"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.
Each query runs to the end into a sink that discards the rows. ``import_rows_per_sec`` is the number
of export rows over the time of the full import, to compare with the baseline's 8-17 k rows/s.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["bulk_sync", "sync_summary", "sync_progress", "stock_ledger", "apply_deltas", "event_results", "reconcile",
            "apply_patches", "build_update_payload", "decide_purchases", "top_listings", "inventory_stats",
            "clean_properties", "validate_rows", "scrub_markup", "latency_report", "recent_throttles", "outage_sessions",
            "throttle_audit", "adaptive_limits"]


def main() -> None:
    from stockline import fixtures
    from stockline.registry import registered
    from stockline.session import build_session, provide_shared_folder

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("stockline-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    provide_shared_folder(spark)
    queries = {name: query for name, (query, _) in registered().items()}
    only = sys.argv[1:] or HEADLINE
    fixtures.export(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in only:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    result = {"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
              "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("/sf", 1)[-1]}
    if "bulk_sync" in seconds:
        rows = fixtures.export(spark, sf_dir).count()
        result["import_rows"] = rows
        result["import_rows_per_sec"] = round(rows / seconds["bulk_sync"])
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
