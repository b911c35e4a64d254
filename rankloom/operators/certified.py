"""Fusion whose first places are certain, though no ranked list is read to its end.

Fusing lists that are cut at some depth can miss a document that stands just below the cut in all of them.
A list of depth D says of every document it does not show that its rank is beyond D, which bounds what the
list can add. From these bounds a query's first k documents are certain once

- each of them is shown by every list, or the lists that do not show it are at their end, and
- the k-th of them is above all that any other document can reach, shown or not.

Queries that are not certain yet are asked again, ``growth`` times as deep, in rounds; the others are done.

A document that leads one list can stand anywhere in another, so lists would often be read to their end for the
place of a few. Retrievers that have ``places(queries, pairs)`` are asked for those places instead, once the lists
are deep enough that no document beyond them can be among the first k. The run is the same as that of fusing
whole lists.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rankloom.config import HybridConfig
from rankloom.functions.guards import positive_k
from rankloom.functions.scores import FUSION_DIGITS
from rankloom.operators.fusion import fuse, rrf_top_k
from rankloom.operators.ranking import top_k
from rankloom.operators.retrievers import Retriever
from rankloom.session import materialise


@dataclass(frozen=True)
class CertifiedRun:
    """The run, and for every query the number of rounds and the depth it took: ``(qid, rounds, depth)``."""

    run: DataFrame
    rounds: DataFrame


def certified_top_k(
    retrievers: Mapping[str, Retriever], queries: DataFrame, k: int, config: HybridConfig = HybridConfig(), growth: int = 4
) -> CertifiedRun:
    """First ``k`` documents of the fusion of whole lists. Starts jobs while the plan is built."""
    depth = config.fetch_depth(positive_k(k))
    if growth < 2:
        raise ValueError(f"lists have to get deeper from round to round; growth is {growth}")
    for name in retrievers:
        config.weight(name)
    pending = materialise(queries.select("qid", "text"), "fusion-queries")
    runs, rounds, number = [], [], 0
    # Lists of a repeated query run into each other, and hold a document more than once.
    repeated = pending.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("qid").isNull())
    by_places = all(hasattr(side, "places") for side in retrievers.values()) and not repeated.limit(1).count()
    while pending.limit(1).count():
        number += 1
        sides = {name: materialise(side.retrieve(pending, depth), f"fusion-{name}") for name, side in retrievers.items()}
        first = materialise(rrf_top_k(sides, k, config), "fusion-first")
        certain = materialise(_certain(pending, sides, first, k, depth, config), "fusion-certain")
        runs.append(first.join(certain, "qid", "left_semi"))
        rounds.append(certain.select("qid", F.lit(number).alias("rounds"), F.lit(depth).alias("depth")))
        if number > 1 and by_places:
            left = materialise(pending.join(certain, "qid", "left_anti"), "fusion-queries")
            completed = _completed(retrievers, left, sides, k, depth, config)
            if completed is not None:
                found, certain_now = completed
                runs.append(found)
                rounds.append(certain_now.select("qid", F.lit(number).alias("rounds"), F.lit(depth).alias("depth")))
                certain = certain.unionByName(certain_now)
        # Written, so that the next round does not go through this one again.
        pending = materialise(pending.join(certain, "qid", "left_anti"), "fusion-queries")
        depth *= growth
    if not runs:
        sides = {name: side.retrieve(pending, depth) for name, side in retrievers.items()}
        return CertifiedRun(rrf_top_k(sides, k, config), pending.select("qid", F.lit(0).alias("rounds"), F.lit(0).alias("depth")))
    return CertifiedRun(reduce(DataFrame.unionByName, runs), reduce(DataFrame.unionByName, rounds))


def _bounded(
    pending: DataFrame, sides: Mapping[str, DataFrame], depth: int, config: HybridConfig
) -> tuple[DataFrame, DataFrame]:
    """By query, what each list can add to a document that it does not show; and every document that is shown, with
    its score so far and what the lists that do not show it can add: ``(qid, doc_id, score, open, __<side>)``."""
    tails = pending.select("qid")
    for name, run in sides.items():
        # A list shorter than asked for has ended: it adds nothing to what it does not show.
        shown = run.groupBy("qid").agg(F.count(F.lit(1)).alias("shown"))
        most = F.when(F.coalesce("shown", F.lit(0)) < depth, F.lit(0.0)).otherwise(
            F.lit(float(config.weight(name)) / (config.rrf_k + depth + 1))
        )
        tails = tails.join(shown, "qid", "left").withColumn(f"__{name}", most).drop("shown")
    bounded = fuse(sides, config).join(tails, "qid")
    open_parts = [F.when(F.col(f"{name}_rank").isNull(), F.col(f"__{name}")).otherwise(F.lit(0.0)) for name in sides]
    shown = bounded.select("qid", "doc_id", "score", reduce(lambda a, b: a + b, open_parts).alias("open"))
    return tails, shown


def _completed(
    retrievers: Mapping[str, Retriever], left: DataFrame, sides: Mapping[str, DataFrame], k: int, depth: int, config: HybridConfig
) -> tuple[DataFrame, DataFrame] | None:
    """The first ``k`` of those queries of ``left`` for which no document beyond the lists can be among them, and
    these queries. The places that the lists do not show are asked for. Nothing if a retriever cannot tell them."""
    sides = {name: materialise(run.join(left.select("qid"), "qid", "left_semi"), f"fusion-{name}") for name, run in sides.items()}
    tails, shown = _bounded(left, sides, depth, config)
    shown = materialise(shown, "fusion-shown")
    # The k-th best of the scores so far: k documents are sure to reach it.
    least = top_k(shown, k, [F.col("score").desc(), F.col("doc_id").asc()]).groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("score"), FUSION_DIGITS).alias("least")
    )
    unseen = reduce(lambda a, b: a + b, [F.col(f"__{name}") for name in sides])
    full = (F.col("n") >= k) & (F.col("least") > F.round(unseen, FUSION_DIGITS))
    closed = tails.join(least, "qid", "left").where((unseen == 0.0) | F.coalesce(full, F.lit(False)))
    closed = materialise(closed.select("qid", F.when(F.col("n") >= k, F.col("least")).alias("least")), "fusion-closed")
    reach = F.round(F.col("score") + F.col("open"), FUSION_DIGITS)
    able = shown.join(closed, "qid").where(F.col("least").isNull() | (reach >= F.col("least")))
    able = materialise(able.select("qid", "doc_id"), "fusion-able")
    asked = left.join(closed.select("qid"), "qid", "left_semi")
    whole = {}
    for name, run in sides.items():
        known = run.join(able, ["qid", "doc_id"], "left_semi").select("qid", "doc_id", "rank")
        missing = materialise(able.join(known, ["qid", "doc_id"], "left_anti"), f"fusion-missing-{name}")
        places = retrievers[name].places(asked, missing)
        if places is None:
            return None
        whole[name] = known.unionByName(places.select("qid", "doc_id", "rank"))
    return materialise(rrf_top_k(whole, k, config), "fusion-first"), closed.select("qid")


def _certain(
    pending: DataFrame, sides: Mapping[str, DataFrame], first: DataFrame, k: int, depth: int, config: HybridConfig
) -> DataFrame:
    """``(qid)`` of the queries whose first places no other document can take."""
    tails, bounded = _bounded(pending, sides, depth, config)
    placed = bounded.join(first.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")
    inside, outside = F.col("rank").isNotNull(), F.col("rank").isNull()
    found = placed.groupBy("qid").agg(
        F.count("rank").alias("places"),
        F.max(F.when(inside, F.col("open"))).alias("unsure"),
        F.min(F.when(inside, F.col("score"))).alias("last"),
        F.max(F.when(outside, F.col("score") + F.col("open"))).alias("next"),
        F.max(F.when(outside, F.col("open"))).alias("next_open"),
    )
    unseen = reduce(lambda a, b: a + b, [F.col(f"__{name}") for name in sides])
    ended = unseen == 0.0
    last = F.round("last", FUSION_DIGITS)
    # Equal scores are told apart by ranks, which a document that is not shown everywhere may still change.
    no_other = F.coalesce(
        (last > F.round("next", FUSION_DIGITS)) | ((last == F.round("next", FUSION_DIGITS)) & (F.col("next_open") == 0.0)), F.lit(True)
    )
    full = (F.col("places") >= k) & (last > F.round(unseen, FUSION_DIGITS))
    sure = (F.coalesce("unsure", F.lit(0.0)) == 0.0) & no_other & (full | ended)
    return tails.join(found, "qid", "left").where(ended | F.coalesce(sure, F.lit(False))).select("qid")
