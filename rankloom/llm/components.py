"""Connected components of a graph given as a table of edges, by alternating star contractions.

In a large-star step every node hands its larger neighbours to the smallest node it knows; in a
small-star step it does so with its smaller neighbours. Both keep the components, and in the end every
node hangs directly on the smallest of its component. Minima are aggregated before the shuffle. Nodes that
hold more than one part in ``HUBS`` of the edges, fewer than that many, meet their minima by broadcast, so no
node of a shuffled join is large. Every round is written to the shared folder, so a lost executor costs one step. The driver only sees counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankloom.session import materialise

HUBS = 1 << 12


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with the minimum of their node u, whose number of edges is n."""
    limit = F.lit(edges.count() // HUBS)
    hubs = F.broadcast(least.where(F.col("n") > limit).drop("n"))
    return edges.join(hubs, "u").unionByName(edges.join(least.where(F.col("n") <= limit).drop("n"), "u"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of edges (u, v) with u > v."""
    if large:
        seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"), F.count(F.lit(1)).alias("n"))
        moved = _with_least(seen, least).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n"))
        below = _with_least(edges, least)
        moved = below.where(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("least").alias("v")))
    return moved.distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node and component, the smallest node that can be reached; nodes without an edge do not appear.

    ``edges`` has columns u and v of one integer type, in any direction, repeated or not.
    """
    now = edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    now = materialise(now.distinct(), label)
    while not _is_forest_of_stars(now):
        # Written after each step: the next one reads it several times.
        now = materialise(_star(materialise(_star(now, large=True), label), large=False), label)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether no node has two edges downward, or one downward and one upward."""
    upper = edges.groupBy("u").agg(F.count("*").alias("n"))
    if upper.where("n > 1").limit(1).count():
        return False
    return not edges.select("v").distinct().join(upper.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
