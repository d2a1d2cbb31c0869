"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query's full result is computed by writing it to Spark's ``noop``
sink (no driver collect).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "x1_analyze_contracts",
    "m1_summary_documents",
    "m3_tfidf_summary",
    "m5_key_phrases",
    "c2_classify_lines",
    "e7_entities_contracts",
    "e4_legal_terms",
    "g5_header_sections",
    "s12_pages_to_text",
    "a2_span_prf",
    "d4_split_rows",
    "s7_merge_store",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from clauselake.plans.queries import queries
    from clauselake.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16,
                          app="clauselake-bench")
    qs = queries()
    names = [a for a in sys.argv[1:] if a in qs] or list(HEADLINE)
    # warm-up on the smallest scale: JIT compilation and session start-up
    # are not part of any query's time
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for name in names:
            qs[name](spark, warm).write.format("noop").mode("overwrite").save()
    latency = small_batches(spark, warm)
    times = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "baseline_latency": latency}))


def small_batches(spark, train_dir: str) -> dict:
    """The reference's only timing figures are small-batch latencies
    text.  Measured here on one warm session (model training not timed)."""
    from pyspark.sql import functions as F

    from clauselake.operators.entities import legal_entities
    from clauselake.operators.ml import fit_clause_model, predict_clauses
    from clauselake.operators.prep import prepare_classifier
    from clauselake.operators.summary import summarize
    from clauselake.sources.fixtures import annotated_corpus

    two = spark.createDataFrame(
        [(1, "Harbour Nine Corp lets a berth to Marigold Ltd until 3/4/2031."),
         (2, "The owner must settle $840 before the first night afloat.")], "doc_id long, text string")
    one = spark.createDataFrame([(1, "A berth is let from Mar 4, 2031 to the sloop Marigold. The owner must settle $840 a "
                                     "season. The harbour office cannot promise shelter from storms. Either side may end "
                                     "the lease with two weeks of notice.")], "doc_id long, text string")
    model = fit_clause_model(prepare_classifier(annotated_corpus(spark, train_dir)).withColumn("weight", F.lit(1.0)))
    out = {}
    for name, fn in (("ner_batch_2_sec", lambda: legal_entities(two).collect()),
                     ("classifier_batch_2_sec", lambda: predict_clauses(model, two).collect()),
                     ("summary_batch_1_sec", lambda: summarize(one).collect())):
        fn()  # warm
        best = float("inf")
        for _ in range(3):  # latency: best of three warm runs
            t0 = time.time()
            fn()
            best = min(best, time.time() - t0)
        out[name] = round(best, 3)
    return out


if __name__ == "__main__":
    main()
