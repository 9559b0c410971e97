"""Times headline queries; prints one JSON line.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1); BENCH_CPUS: threads (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from brindle import queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "pricing_summary",
    "table_scan",
    "handle_range_scan",
    "filter_and_or_not",
    "filter_like",
    "proj_int_div_mod",
    "fn_substr",
    "fn_date_parts",
    "agg_sum",
    "agg_avg_scale4",
    "agg_count_distinct",
    "agg_group_concat",
    "agg_partial_final",
    "topn_multi_key",
    "index_lookup_filter",
    "coll_ci_group",
    "analyze_columns",
    "split_keys",
    "mvcc_snapshot_scan",
    "mvcc_gc",
    "raw_scan",
    "cdc_incremental",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    queries.QUERIES["pricing_summary"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # starts the engine
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            queries.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "total of headline queries, best of two", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
