"""Benchmark of the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with ``local[$BENCH_CPUS]``:
one warm-up run, then ``$BENCH_REPEAT`` (default 3) timed runs; the median is reported.
A run executes the whole plan into the ``noop`` sink (no collect to the driver).
Prints one JSON line: {"metric", "value" (sum of medians), "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpus_search.plans.catalog import QUERIES  # noqa: E402
from corpus_search.session import local_session  # noqa: E402

HEADLINE = [
    "retrieve_context",
    "rerank_bm25",
    "knn_exact",
    "knn_ivf",
    "embed_hash",
    "chunk_fixed",
    "chunk_recursive",
    "chunk_tokens",
    "exact_dedup",
    "extract_page_text",
    "stage_metrics",
    "stage_running_totals",
    "step_elapsed",
    "history_before_turn",
    "classifier_accuracy",
    "collection_count",
]


def run_once(spark, name: str, sf: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="corpus_search_bench")
    spark.sparkContext.setLogLevel("ERROR")
    results = {}
    for name in names:
        run_once(spark, name, sf)  # warm-up (Python workers, file listing caches)
        times = [run_once(spark, name, sf) for _ in range(repeat)]
        results[name] = round(statistics.median(times), 3)
        print(f"# {name}: {results[name]:.3f}s {[round(t, 2) for t in times]}", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(results.values()), 3),
        "unit": "sec",
        "queries": results,
        "sf": float(m.group(1)) if m else sf,
        "cpus": cpus,
        "repeat": repeat,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
