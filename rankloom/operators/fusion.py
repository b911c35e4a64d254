"""Reciprocal rank fusion of any number of ranked runs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from rankloom.config import HybridConfig
from rankloom.functions.guards import positive_k
from rankloom.functions.scores import FUSION_DIGITS, reciprocal_rank
from rankloom.operators.ranking import top_k


def contributions(runs: Mapping[str, DataFrame], config: HybridConfig = HybridConfig()) -> DataFrame:
    """What every place of every run adds to a document: ``weight / (rrf_k + rank)``."""
    parts = [
        run.select(
            "qid",
            "doc_id",
            F.lit(method).alias("method"),
            F.col("rank").cast("int").alias("rank"),
            reciprocal_rank(F.lit(float(config.weight(method))), F.col("rank"), config.rrf_k).alias(
                "contribution"
            ),
        )
        for method, run in runs.items()
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def fuse(runs: Mapping[str, DataFrame], config: HybridConfig = HybridConfig()) -> DataFrame:
    """Sum of contributions per query and document, with the place taken in each run.

    A union and one aggregation take the place of a full outer join.
    """
    ranks = [
        F.min(F.when(F.col("method") == method, F.col("rank"))).alias(f"{method}_rank") for method in runs
    ]
    return (
        contributions(runs, config)
        .groupBy("qid", "doc_id")
        .agg(F.sum("contribution").alias("score"), *ranks)
    )


def rrf_top_k(runs: Mapping[str, DataFrame], k: int, config: HybridConfig = HybridConfig()) -> DataFrame:
    """First ``k`` fused documents of the runs as deep as they are given. Equal scores keep the order
    of the runs: those of the first run by their place there, then those of the second, and so on."""
    positive_k(k)
    order = [F.round("score", FUSION_DIGITS).desc()]
    order += [F.col(f"{method}_rank").asc_nulls_last() for method in runs]
    # A document repeated within one run may share all places with another one.
    order += [F.col("doc_id").asc()]
    return top_k(fuse(runs, config), k, order).select("qid", "doc_id", "score", "rank")
