"""Evaluation of several retrieval methods on one set of queries."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from rankloom.config import EvalConfig, HybridConfig
from rankloom.functions.guards import deep_enough
from rankloom.operators.fusion import rrf_top_k
from rankloom.operators.metrics import mean_metrics, to_wide
from rankloom.operators.ranking import cut
from rankloom.operators.report import method_table
from rankloom.operators.retrievers import Retriever
from rankloom.operators.sampling import eligible_queries, sample_queries
from rankloom.session import materialise
from rankloom.sources.datasets import binary_qrels

HYBRID = "hybrid"


@dataclass(frozen=True)
class Evaluation:
    """Evaluated queries, the runs by method, their mean metrics in long form, batch timings."""

    queries: DataFrame
    run: DataFrame
    metrics: DataFrame
    latency: DataFrame
    ks: tuple[int, ...]

    @property
    def table(self) -> DataFrame:
        return method_table(to_wide(self.metrics, self.ks), self.latency)


def fused_sides(names: Sequence[str], fusion: HybridConfig) -> tuple[str, ...]:
    """The retrievers that the hybrid method fuses: those with a weight, if there are two or more."""
    sides = tuple(name for name in names if name in fusion.weights)
    return sides if len(sides) > 1 else ()


def choose_methods(method: str, names: Sequence[str], fusion: HybridConfig = HybridConfig()) -> tuple[str, ...]:
    """One of the retrievers' names, ``hybrid`` where two sides or more can be fused, or ``all``."""
    known = [name for name in names if name != HYBRID]
    if fused_sides(known, fusion):
        known.append(HYBRID)
    if method == "all":
        return tuple(known)
    if method not in known:
        raise ValueError(f"unknown method {method!r}: choose one of {', '.join(known)} or all")
    return (method,)


def evaluation_queries(queries: DataFrame, qrels: DataFrame, config: EvalConfig) -> DataFrame:
    return sample_queries(eligible_queries(queries, qrels), config.limit_queries, config.seed)


def base_runs(
    retrievers: Mapping[str, Retriever],
    queries: DataFrame,
    methods: Sequence[str],
    depth: int,
    fusion: HybridConfig,
) -> tuple[dict[str, DataFrame], dict[str, float]]:
    """Run each side once, as deep as fusion reads it, and write the rows down.

    A run has at most ``depth`` rows per query. Written once, it serves both its own metrics and
    the fusion. The seconds of each job are returned with it.
    """
    sides = fused_sides(list(retrievers), fusion) if HYBRID in methods else ()
    runs, seconds = {}, {}
    for name in retrievers:
        if name not in methods and name not in sides:
            continue
        deepest = max(depth, fusion.fetch_depth(depth)) if name in sides else depth
        start = time.perf_counter()
        runs[name] = materialise(retrievers[name].retrieve(queries, deepest), f"run-{name}")
        seconds[name] = time.perf_counter() - start
    return runs, seconds


def method_runs(
    runs: Mapping[str, DataFrame], methods: Sequence[str], depth: int, fusion: HybridConfig
) -> DataFrame:
    """Runs of all chosen methods in one frame, tagged by method and cut to ``depth``."""
    frames = []
    for name in methods:
        if name == HYBRID:
            sides = fused_sides(list(runs), fusion)
            run = rrf_top_k({side: runs[side] for side in sides}, depth, fusion)
        else:
            run = cut(runs[name], depth)
        frames.append(run.select(F.lit(name).alias("method"), "qid", "doc_id", "score", "rank"))
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame)
    return union


def evaluate(
    retrievers: Mapping[str, Retriever],
    queries: DataFrame,
    qrels: DataFrame,
    method: str = "all",
    config: EvalConfig = EvalConfig(),
    fusion: HybridConfig = HybridConfig(),
    depth: int | None = None,
) -> Evaluation:
    """Run the methods on the judged queries, all or a sample, and average the metrics.

    Any retrievers can be compared: methods are the names in ``retrievers``, and ``hybrid`` for the
    fusion of those that have a weight. ``qrels`` with a score column are cut at ``min_relevance``.

    ``avg_latency_ms`` is batch time divided by the number of queries: all queries run at once, so
    it is a throughput figure and not the wait of a single user.
    """
    methods = choose_methods(method, list(retrievers), fusion)
    if "score" in qrels.columns:
        qrels = binary_qrels(qrels, config.min_relevance)
    depth = deep_enough(depth or max(config.ks), config.ks)
    selected = materialise(evaluation_queries(queries, qrels, config), "queries")
    runs, seconds = base_runs(retrievers, selected, methods, depth, fusion)
    start = time.perf_counter()
    run = materialise(method_runs(runs, methods, depth, fusion), "run-all")
    if HYBRID in methods:
        sides = fused_sides(list(runs), fusion)
        seconds[HYBRID] = sum(seconds[side] for side in sides) + time.perf_counter() - start
    count = max(1, selected.count())
    spark = queries.sparkSession
    latency = spark.createDataFrame(
        [(name, seconds[name] * 1000.0 / count) for name in methods], "method string, avg_latency_ms double"
    )
    return Evaluation(selected, run, mean_metrics(selected, run, qrels, config.ks, methods), latency, config.ks)
