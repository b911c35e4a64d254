"""Headline jobs over the test tables; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).

Searches answer all queries of the `benchmark` table in one batch. Each job runs once to warm up
and then BENCH_RUNS times (default 3); the median is reported, and the first run as well.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from rankloom.config import EvalConfig
from rankloom.operators import dense, encoding, fusion, lexical, metrics
from rankloom.plans import testbed
from rankloom.plans.evaluation import evaluate
from rankloom.plans.registry import KS, QUERIES, K
from rankloom.session import local_session, scratch_path
from rankloom.sources import indexes


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session("bench", cores=cpus, partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")

    def run(frame) -> None:
        frame.write.format("noop").mode("overwrite").save()

    corpus, queries = testbed.corpus(spark, folder), testbed.queries(spark, folder)
    index = testbed.text_index(spark, folder)
    vectors = testbed.document_vectors(spark, folder)
    sides = testbed.runs(spark, folder)
    qrels = testbed.qrels(spark, folder)

    def dense_search():
        asked = encoding.hash_queries(index, queries, testbed.DENSE)
        return dense.dense_top_k(asked, vectors, K, testbed.DENSE)

    def hybrid_search():
        depth = 2 * K
        asked = encoding.hash_queries(index, queries, testbed.DENSE)
        both = {
            "bm25": lexical.bm25_top_k(index, queries, depth),
            "dense": dense.dense_top_k(asked, vectors, depth, testbed.DENSE),
        }
        return fusion.rrf_top_k(both, K)

    def evaluation():
        result = evaluate(
            testbed.retrievers(spark, folder), queries, qrels, config=EvalConfig(dataset="testbed")
        )
        result.table.collect()

    jobs = {
        "build_text_index": lambda: indexes.write_text_index(spark, corpus, scratch_path(spark, "bench-index")),
        "build_vectors": lambda: indexes.write_vectors(
            encoding.hash_documents(index, corpus, testbed.DENSE), scratch_path(spark, "bench-vectors")
        ),
        "bm25_topk": lambda: run(lexical.bm25_top_k(index, queries, K)),
        "dense_text_topk": lambda: run(dense_search()),
        "hybrid_topk": lambda: run(hybrid_search()),
        "dense_ip_topk": lambda: run(QUERIES["dense_ip_topk"](spark, folder)),
        "rrf_topk": lambda: run(fusion.rrf_top_k(sides, K)),
        "eval_run": lambda: metrics.mean_metrics(
            queries, sides["bm25"], qrels, KS, ("bm25",)
        ).collect(),
        "eval_all_methods": evaluation,
    }
    medians, first = {}, {}
    for name, job in jobs.items():
        times = []
        for _ in range(1 + runs):
            start = time.perf_counter()
            job()
            times.append(time.perf_counter() - start)
        first[name] = round(times[0], 3)
        medians[name] = round(statistics.median(times[1:]), 3)
        print(name, first[name], medians[name], file=sys.stderr, flush=True)

    n_queries, n_docs = queries.count(), corpus.count()
    searches = ("bm25_topk", "dense_text_topk", "hybrid_topk")
    print(
        json.dumps(
            {
                "metric": "total_median_seconds",
                "value": round(sum(medians.values()), 3),
                "unit": "sec",
                "queries": medians,
                "first_run": first,
                "batch_ms_per_query": {name: round(1000 * medians[name] / n_queries, 2) for name in searches},
                "queries_per_second": {name: round(n_queries / medians[name], 1) for name in searches},
                "n_queries": n_queries,
                "n_documents": n_docs,
                "cpus": cpus,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
