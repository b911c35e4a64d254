"""Ranking: best first per query, ties by document id, cut at k."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.functions.guards import positive_k
from rankloom.functions.scores import single_precision

# Up to this k Spark itself cuts every partition to k rows per query before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold).
_SPARK_CUTS_UP_TO = 1000
# With this many partitions or more, the rows of a query are cut in two steps.
_MANY_PARTITIONS = 1000


def score_order() -> list[Column]:
    return [single_precision(F.col("score")).desc(), F.col("doc_id").asc()]


def top_k(scored: DataFrame, k: int, order: Sequence[Column] | None = None, query: Sequence[str] = ("qid",)) -> DataFrame:
    """Add ``rank`` from 1 and keep the first ``k`` rows of every query.

    A query can match nearly every document. For small k Spark cuts each partition to k rows per
    query before shuffling, so one task gets k rows per partition. Where that is many, or k is large,
    the rows of a query are first spread over slices by document and each slice is cut.
    """
    positive_k(k)
    order = list(order or score_order())
    query = list(query)
    partitions = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if k > _SPARK_CUTS_UP_TO or partitions >= _MANY_PARTITIONS:
        # About as many rows then meet per slice as slices per query.
        slices = partitions if k > _SPARK_CUTS_UP_TO else math.isqrt(partitions)
        scored = (
            scored.withColumn("__slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices)))
            .withColumn("rank", F.row_number().over(Window.partitionBy(*query, "__slice").orderBy(*order)))
            .where(F.col("rank") <= k)
            .drop("rank", "__slice")
        )
    ranked = F.row_number().over(Window.partitionBy(*query).orderBy(*order))
    return scored.withColumn("rank", ranked).where(F.col("rank") <= k)


def cut(run: DataFrame, k: int) -> DataFrame:
    """The first ``k`` places of a run that is ranked already."""
    positive_k(k)
    return run.where(F.col("rank") <= k)
