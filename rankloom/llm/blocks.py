"""Comparing all rows of a group block by block, for groups of any size.

A group is dealt into blocks by a hash of its rows, as many as its weight asks for. Each pair of blocks is
one unit of work; a row goes to the units of its own block with every block of the group. Small groups
share a unit. Within a unit, plain arrays are compared; no row per pair is ever made.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

_SEED = 31


def plan_groups(groups: DataFrame, block_weight: int) -> DataFrame:
    """Add blocks (at least 1) to ``groups``, which has one row per group with its weight."""
    return groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("weight") / block_weight)).cast("int"))


def to_units(rows: DataFrame, key: str, group: Column, blocks: Column, bins: int) -> DataFrame:
    """Rows repeated once per unit they take part in, with unit (string), block, left and right.

    Units are pairs of blocks left <= right. Groups of one block are put together in ``bins`` units.
    """
    own = F.pmod(F.xxhash64(F.lit(_SEED), F.col(key)), blocks).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda other: F.struct(F.least(F.col("block"), other).alias("left"), F.greatest(F.col("block"), other).alias("right")),
    )
    bin_name = F.concat(F.lit("bin "), F.pmod(F.xxhash64(F.lit(_SEED), group), F.lit(bins)).cast("string"))
    unit = F.when(blocks == 1, bin_name).otherwise(
        F.concat_ws(" ", group.cast("string"), F.col("pair.left").cast("string"), F.col("pair.right").cast("string"))
    )
    return (
        rows.withColumn("block", own)
        .withColumn("pair", F.explode(pairs))
        .withColumn("unit", unit)
        .withColumns({"left": F.col("pair.left"), "right": F.col("pair.right")})
        .drop("pair")
    )


class Forest:
    """Union-find over the rows of one unit; the smallest key names a tree."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.parent = np.arange(len(keys))

    def root(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def join(self, a: int, others: np.ndarray) -> None:
        for b in others:
            x, y = self.root(a), self.root(int(b))
            if x != y:
                if self.keys[x] > self.keys[y]:
                    x, y = y, x
                self.parent[y] = x

    def names(self) -> np.ndarray:
        """For every row, the smallest key of its tree."""
        return self.keys[np.array([self.root(k) for k in range(len(self.keys))], dtype=np.int64)]
