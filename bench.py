"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_RUNS (default 3),
BENCH_QUERIES (comma-separated names; default the headline set). Each query is warmed up on the
smallest tables, then runs BENCH_RUNS times, or until it has used BENCH_SECONDS (default 20); the
median counts. Every row of every result is produced (no-op sink).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "screening_flagship", "screen_classifier", "agreement", "calibrate", "match_library", "fold_review_events",
    "chunk_documents", "build_postings", "bm25_search", "dense_search", "rrf_fuse", "select_evidence", "retrieve",
    "check_evidence",
]


def main() -> None:
    from citesieve.plans import registry
    from citesieve.session import get_spark

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = get_spark("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.sql.files.maxPartitionBytes": "4m", "spark.sql.warehouse.dir": "/tmp/spark-warehouse"})
    spark.sparkContext.setLogLevel("OFF")
    queries, seconds = registry.queries(), {}
    limit = float(os.environ.get("BENCH_SECONDS", "20"))
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")

    def timed(name: str, folder: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        spent = time.perf_counter() - start
        spark.catalog.clearCache()
        return spent

    for name in names:
        if os.path.isdir(small):
            timed(name, small)
        taken = []
        while len(taken) < runs and sum(taken) < limit:
            taken.append(timed(name, sf))
        seconds[name] = round(statistics.median(taken), 3)
        print(f"{seconds[name]:8.2f}s {name}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": cores, "runs": runs}))


if __name__ == "__main__":
    main()
