"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully evaluated through the ``noop`` sink (no collect to the
driver).  A warm-up query on the smallest scale starts the JVM and Python
workers first.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagesift.plans.queries import QUERIES  # noqa: E402
from pagesift.session import get_spark  # noqa: E402

HEADLINE = [
    "segment_blocks",
    "block_labels",
    "block_features",
    "feature_vectors",
    "scaled_features",
    "nb_model",
    "nb_predict",
    "extract_article",
    "eval_tokens",
    "eval_lcs",
    "eval_report",
    "score_curve",
    "svm_score",
]
# Alternative forms and the protocols with many fits, timed apart (not in the
# headline total).
COMPARISONS = ["block_features_window", "nb_text_predict", "nb_cv_tokens", "cv_eval", "block_cv"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = get_spark(master=f"local[{cpus}]", app="pagesift-bench",
                      shuffle_partitions=max(int(cpus), 1))
    warm = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(warm):
        QUERIES["segment_blocks"](spark, warm).write.format("noop").mode("overwrite").save()
    def timed(name):
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spark.catalog.clearCache()
        return round(time.perf_counter() - t0, 3)

    times = {name: timed(name) for name in (only or HEADLINE)}
    comparisons = {} if only else {name: timed(name) for name in COMPARISONS}
    n_pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    total = round(sum(times.values()), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_total_sec", "value": total, "unit": "sec",
        "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "comparisons": comparisons,
        "pages": n_pages,
        "segment_pages_per_sec": round(n_pages / times["segment_blocks"], 1)
        if times.get("segment_blocks") else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
