"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once untimed on the smallest data (JVM warm-up) and once timed on the full tables; the
whole result is computed and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "rewrite_documents", "detect_all_documents", "rewrite_notes", "detect_all_notes", "mask_dispatch",
    "replace_pseudonym", "rewrite_columns", "merge_overlaps", "entity_frequency", "audit_log",
    "apply_second_pass", "detect_person", "stream_rewrite",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus) if cpus.isdigit() else 16))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("cloakframe.input.partitions", str(2 * int(cpus) if cpus.isdigit() else 16)).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from registry.queries import QUERIES

    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    seconds = {}
    for name in names:
        if os.path.isdir(warm):
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }), flush=True)


if __name__ == "__main__":
    main()
