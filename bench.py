"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  input tables (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default 8)
"""

from __future__ import annotations

import json
import os
import time

from daybook import queries
from daybook.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Files and tables the queries share are made first; their time is part of the total.
PREPARED = {"landing_write": queries._landing, "two_runs": queries._two_runs,
            "loaded_store": queries._loaded, "text_landing": queries._text_landing}

HEADLINE = ("ingest_rows", "line_scan", "daily_counts", "spine", "pending_days", "present_days",
            "stream_rows", "inferred_types", "line_labels", "file_lines", "snapshot_preview",
            "sample_check", "day_check", "readable_files", "error_summary")


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("OFF")
    consume(spark.read.parquet(f"{SF_DIR}/orders.parquet"))  # start the executor
    seconds, cold = {}, {}
    for name, make in PREPARED.items():
        seconds[name] = timed(lambda: queries._once(spark, SF_DIR, make))
    for name in HEADLINE:
        query = queries.QUERIES[name]
        # The first run pays for compiling the plan; both are reported.
        cold[name] = timed(lambda: consume(query(spark, SF_DIR)))
        seconds[name] = timed(lambda: consume(query(spark, SF_DIR)))
    # Two backfills, the landing and the other files that queries share count as well.
    print(json.dumps({"metric": "headline queries and what they read, total, warm",
                      "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "cold": cold, "sf": os.path.basename(SF_DIR).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
