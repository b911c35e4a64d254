"""Blocked Bloom filters as tables, built and asked with DataFrame functions.

One hash of a key picks a block of 256 bits, others set two bits in each of its four words. The filter is
a table of blocks, made by one aggregation with a bitwise or. Its size has a fixed bound, so it may be
broadcast: with more keys than the blocks are meant for, more rows pass, but no row with a key is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORDS = 4
BITS_PER_KEY = 16
# 131,072 blocks of 256 bits: two million keys at 16 bits each, a table of 5 MB.
MAX_BLOCKS = 1 << 17

_BLOCK_SEED, _BIT_SEED = 11, 23


def block_count(keys: int, max_blocks: int = MAX_BLOCKS) -> int:
    return max(1, min(max_blocks, -(-keys * BITS_PER_KEY // (64 * WORDS))))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(_BLOCK_SEED), key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """Two bits in each word of the block, from one hash of 48 bits."""
    hashed = F.xxhash64(F.lit(_BIT_SEED), key)
    one = F.lit(1).cast("long")

    def bit(k: int) -> Column:
        place = F.shiftrightunsigned(hashed, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", one, place)

    return [bit(2 * k).bitwiseOR(bit(2 * k + 1)) for k in range(WORDS)]


def build(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter of the values in column ``key``: one row per block in use, with its words."""
    masks = [mask.alias(f"m{k}") for k, mask in enumerate(_masks(F.col(key)))]
    return (
        keys.select(_block(F.col(key), blocks).alias("__block"), *masks)
        .groupBy("__block")
        .agg(*[F.bit_or(f"m{k}").alias(f"__w{k}") for k in range(WORDS)])
    )


def mark(rows: DataFrame, key: str, bloom: DataFrame, blocks: int, name: str = "possible") -> DataFrame:
    """``rows`` with a column that is false where the filter cannot hold the row's key; null keys are out."""
    asked = rows.withColumn("__block", _block(F.col(key), blocks)).join(F.broadcast(bloom), "__block", "left")
    every = F.col(key).isNotNull()
    for k, mask in enumerate(_masks(F.col(key))):
        every = every & (F.col(f"__w{k}").bitwiseAND(mask) == mask)
    return asked.withColumn(name, F.coalesce(every, F.lit(False))).drop("__block", *[f"__w{k}" for k in range(WORDS)])
