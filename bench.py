"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``queries`` holds the better of two warm runs, ``cold`` the first run of each. Rows are computed in
full and thrown away (noop sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "repository_rollup", "core_issues", "file_scores", "file_metrics", "web_scores", "quick_issues", "first_issues",
    "review_digest", "imports", "declared_packages", "bandit_issues", "completed_runs", "replaced_configs",
]


def main() -> None:
    from pyspark.sql import functions as F

    from tests.sessions import local_session
    from workload import QUERIES
    from workload.corpus import source_files

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, memory="16g")

    def run(name):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    cold = {name: run(name) for name in HEADLINE}
    warm = {name: min(run(name), run(name)) for name in HEADLINE}

    size = source_files(spark, sf_dir).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"),
        F.sum(F.size(F.split(F.col("raw").cast("string"), "\n", -1))).alias("lines"),
    ).first()
    seconds = warm["repository_rollup"]
    print(json.dumps({
        "metric": "headline queries, warm", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cold": cold, "cpus": int(cpus),
        "partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
        "scan_throughput": {
            "files_per_sec": round(size["files"] / seconds, 1), "lines_per_sec": round(size["lines"] / seconds, 1),
            "mb_per_sec": round(size["bytes"] / seconds / 1e6, 2)},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
