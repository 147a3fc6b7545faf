"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print ONE JSON line with per-query wall-clock seconds.

Each query is executed in full with the ``noop`` sink (every row is
produced, nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "g2_word_sentiment",
    "t5_word_frequency",
    "n2_explode_reviews",
    "f10b_stratified_split",
    "f6a_tfidf_bigram_sublinear",
    "m4_naive_bayes",
    "m1_knn_euclid_uniform",
    "e4_report",
    "l1_valence_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from opinia.plans.registry import load_all
    from opinia.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", partitions=int(cpus) * 2, app="opinia-bench")
    queries = load_all()
    names = sys.argv[1:] or HEADLINE
    # warm-up: JVM, codegen caches, file listing
    spark.read.parquet(os.path.join(sf_dir, "documents.parquet")).select("doc_id").write.format("noop").mode(
        "overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        queries[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_wall_clock",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
