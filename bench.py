"""Time the headline queries; prints one JSON line.

The queries share one workspace and run in order, as a refresh does: the first that needs a derived
table (settled positions, wallet scores, consensus, signals) pays for building it from the raw
Parquet files, and what follows reads it. ``queries`` has that first run of each, ``warm`` a second
one, for which the derived tables are there. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["wallet_leaders", "trader_metrics", "behaviour", "fifo_lots", "category_performance",
            "position_curve", "recent_net", "asof_price", "ladder_fill", "tape_flow", "overround",
            "close_bets", "normalize_activity", "insert_ignore", "category_from_text",
            "trader_score", "consensus", "board_rank", "replay_positions", "observed_price",
            "signals", "calibration"]


def main() -> None:
    from checks import registry
    from tidemark.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__ui__enabled="false", spark__driver__memory="12g",
                          spark__checkpoint__dir=os.environ.get("BENCH_SHARED", "/tmp/tidemark-bench"),
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the JVM before the clock
    timings, warm = {}, {}
    space = registry.Workspace(spark, sf_dir)
    for name in names:
        cols, fn, _ = registry.ENTRIES[name]
        for times in (timings, warm):
            start = time.perf_counter()
            registry.conform(fn(space), cols).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(name, timings[name], warm[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "warm": warm, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
