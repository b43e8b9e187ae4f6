"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run to completion with the ``noop`` sink (full computation,
no driver collection) and timed; prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "ordered_output",     # flagship: best offer + pricing + sorted sink form
    "best_offer",
    "price_offers",
    "split_valid",        # parse + validate every feed row
    "sku_map_join",
    "scan_feed",          # CSV files -> positional scan -> normalise
    "write_feed",         # deterministic multi-tenant CSV sink
    "run_summary",        # whole multi-tenant run (engine)
    "latest_inbound",
    "run_ledger",
    "alarm_consecutive",
    "heartbeat_gap",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from feedmerge.session import build_session
    from feedmerge.plans.catalog import REGISTRY

    spark = build_session(f"local[{cpus}]", app_name="feedmerge-bench", shuffle_partitions=int(cpus) * 2,
                          driver_memory="16g")
    # warm-up: JVM, parquet footers, codegen caches
    REGISTRY["best_offer"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    if "scan_feed" in names:
        from feedmerge.plans.feed_files import prepared_feed_files
        prepared_feed_files(spark, sf_dir)  # the input files of scan_feed
    times = {}
    for name in names:
        t0 = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
