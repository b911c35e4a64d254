"""Ranking metrics at several cut-offs.

Input frames: ``run(qid, doc_id, rank)`` with rank from 1 and no gaps, ``qrels(qid, doc_id)`` with
relevant pairs (a pair given twice counts once), and the ``evaluated(qid)`` queries. A query that is
evaluated but retrieved nothing has no run rows; it still counts, with 0. So does a query that was
judged with nothing found relevant, if ``judged(qid)`` names it; without ``judged``, the judged queries
are those of ``qrels``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rankloom.functions.guards import positive_ks
from rankloom.functions.scores import discount, ideal_dcg

METRICS = ("recall", "precision", "mrr", "ndcg")


def relevant_counts(qrels: DataFrame) -> DataFrame:
    return relevant_pairs(qrels).groupBy("qid").agg(F.count(F.lit(1)).alias("n_rel"))


def relevant_pairs(qrels: DataFrame) -> DataFrame:
    return qrels.select("qid", "doc_id").distinct()


def per_query(
    run: DataFrame,
    qrels: DataFrame,
    ks: Sequence[int] = (1, 3, 5, 10),
    by: Sequence[str] = (),
) -> DataFrame:
    """Hits, places, first hit and DCG per (``by``, query, k), for the cut-offs with any place.

    The join is on query and document, and everything else is a sum or a minimum that is formed
    before the shuffle, so a query with very many judgments or places is not gathered anywhere.
    """
    cutoffs = positive_ks(ks)
    places = run.where(F.col("rank") <= max(cutoffs)).select(*by, "qid", "doc_id", "rank")
    judged = places.join(
        relevant_pairs(qrels).withColumn("hit", F.lit(True)), ["qid", "doc_id"], "left"
    )
    reached = F.filter(F.lit(list(cutoffs)), lambda k: k >= F.col("rank"))
    hit_rank = F.when(F.col("hit"), F.col("rank"))
    return (
        judged.withColumn("k", F.explode(reached))
        .groupBy(*by, "qid", "k")
        .agg(
            F.count(hit_rank).alias("hits"),
            F.count(F.lit(1)).alias("places"),
            F.min(hit_rank).alias("first_hit"),
            F.sum(discount(hit_rank)).alias("gain"),
        )
    )


def query_metrics(
    evaluated: DataFrame,
    run: DataFrame,
    qrels: DataFrame,
    ks: Sequence[int] = (1, 3, 5, 10),
    methods: Sequence[str] | None = None,
    judged: DataFrame | None = None,
) -> DataFrame:
    """All metrics of every evaluated query that is judged, one row per query and cut-off.

    With ``methods`` the run carries a ``method`` column and every method has its own rows.
    """
    cutoffs = positive_ks(ks)
    by = ["method"] if methods is not None else []
    frame = evaluated.select("qid").distinct()
    if judged is not None:
        known = judged.select("qid").unionByName(qrels.select("qid"))
        frame = frame.join(known, "qid", "left_semi")
    counts = relevant_counts(qrels)
    frame = frame.join(counts, "qid", "inner" if judged is None else "left").withColumn(
        "n_rel", F.coalesce("n_rel", F.lit(0).cast("bigint"))
    )
    if methods is not None:
        frame = frame.withColumn("method", F.explode(F.lit(list(methods))))
    frame = frame.withColumn("k", F.explode(F.lit(list(cutoffs))))
    joined = frame.join(per_query(run, qrels, cutoffs, by), [*by, "qid", "k"], "left")
    dcg = F.coalesce("gain", F.lit(0.0))
    ideal = ideal_dcg(F.col("n_rel"), F.col("k"))
    return joined.select(
        *by,
        "qid",
        "k",
        "n_rel",
        F.coalesce(F.try_divide(F.col("hits"), F.col("n_rel")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.col("hits") / F.col("places"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.try_divide(dcg, ideal), F.lit(0.0)).alias("ndcg"),
        dcg.alias("dcg"),
        ideal.alias("idcg"),
    )


def mean_metrics(
    evaluated: DataFrame,
    run: DataFrame,
    qrels: DataFrame,
    ks: Sequence[int] = (1, 3, 5, 10),
    methods: Sequence[str] = ("run",),
    judged: DataFrame | None = None,
) -> DataFrame:
    """Mean over the evaluated and judged queries: ``(method, metric, k, value)``.

    Every method and cut-off asked for has all its rows; they are 0 where nothing overlaps. A run
    without a ``method`` column belongs to the only method named.
    """
    cutoffs = positive_ks(ks)
    if "method" not in run.columns:
        if len(methods) != 1:
            raise ValueError("a run without a method column can be measured for one method only")
        run = run.withColumn("method", F.lit(methods[0]))
    means = (
        query_metrics(evaluated, run, qrels, cutoffs, methods, judged)
        .groupBy("method", "k")
        .agg(*[F.avg(name).alias(name) for name in METRICS])
    )
    # One row per method and cut-off asked for, never larger than those two lists.
    asked = (
        evaluated.sparkSession.range(1)
        .select(F.explode(F.lit(list(methods))).alias("method"))
        .withColumn("k", F.explode(F.lit(list(cutoffs))))
    )
    values = F.array(
        *[F.struct(F.lit(name).alias("metric"), F.coalesce(name, F.lit(0.0)).alias("value")) for name in METRICS]
    )
    return (
        asked.join(means, ["method", "k"], "left")
        .select("method", "k", F.inline(values))
        .select("method", "metric", "k", "value")
    )


def metric_names(ks: Sequence[int]) -> list[str]:
    return [f"{metric}@{k}" for k in ks for metric in METRICS]


def to_wide(long: DataFrame, ks: Sequence[int]) -> DataFrame:
    """One row per method with columns named ``metric@k``."""
    named = long.withColumn("name", F.concat_ws("@", "metric", "k"))
    return named.groupBy("method").pivot("name", metric_names(ks)).agg(F.first("value"))


def average_latency_ms(timings: DataFrame, methods: Sequence[str] | None = None) -> DataFrame:
    """Mean seconds per query in milliseconds; a listed method without timings has 0."""
    means = timings.groupBy("method").agg((F.avg("seconds") * 1000.0).alias("avg_latency_ms"))
    if methods is None:
        return means
    asked = timings.sparkSession.range(1).select(F.explode(F.lit(list(methods))).alias("method"))
    return asked.join(means, "method", "left").select(
        "method", F.coalesce("avg_latency_ms", F.lit(0.0)).alias("avg_latency_ms")
    )
