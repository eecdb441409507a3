"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from depotlens.registry import queries
from depotlens.session import get_spark

HEADLINE = ("list_files_page", "list_scans_page", "scan_requests", "counts_by_scan", "dir_rollup", "file_rollup", "message_dedupe", "photo_split", "delete_scan_survivors", "dup_within_scan", "dup_across_scans", "scan_full_diff", "keeper_plan", "top_items_per_scan", "space_by_label", "progress_batch", "progress_stream")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):  # the second run counts: the first compiles
            began = time.time()
            queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
