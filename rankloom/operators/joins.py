"""Joins whose strategy depends on measured sizes and on keys that hold very many rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Rows of one key that a task may get. There can be no more than HEAVY_PARTS heavy keys, whatever the
# data, so their table is always small enough to broadcast: with very many rows in all, a slice is one
# part in HEAVY_PARTS of them.
SLICE_ROWS = 1 << 20
HEAVY_PARTS = 100_000

_SALT = "__salt"
_SALTS = "__salts"


def measured_bytes(df: DataFrame, *text_columns: str) -> int:
    """Size of a frame from one aggregate: its strings, and a flat charge for every row and column."""
    texts = sum((F.coalesce(F.octet_length(name), F.lit(0)) for name in text_columns), F.lit(0))
    flat = 64 + 16 * len(df.columns)
    return df.agg(F.coalesce(F.sum(texts + F.lit(flat).cast("bigint")), F.lit(0))).first()[0]


def broadcast_within(df: DataFrame, limit: int, *text_columns: str) -> DataFrame | None:
    """``df`` marked for broadcast if its measured size is within ``limit``, else nothing."""
    if measured_bytes(df, *text_columns) > limit:
        return None
    return F.broadcast(df)


def heavy_keys(
    key_counts: DataFrame, keys: Sequence[str], count: str, slice_rows: int = SLICE_ROWS, parts: int = HEAVY_PARTS
) -> DataFrame:
    """Keys with more rows than a slice, and the number of slices each is cut into.

    ``key_counts`` has one row per key. The result has fewer than ``parts`` rows.
    """
    total = key_counts.agg(F.coalesce(F.sum(count), F.lit(0))).scalar()
    rows = F.greatest(F.lit(slice_rows), F.ceil(total / parts))
    return key_counts.where(F.col(count) > rows).select(*keys, F.ceil(F.col(count) / rows).cast("int").alias(_SALTS))


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    heavy: DataFrame,
    spread_by: Column,
) -> DataFrame:
    """Inner join by shuffle where a few keys hold much of ``rows``.

    Rows of a heavy key are cut into slices by a hash of ``spread_by`` and the matching lookup
    rows are repeated once per slice, so no task gets much more than a slice on account of one key.
    The set of joined rows is the same as without salting.
    """
    keys = list(keys)
    sliced = (
        rows.join(F.broadcast(heavy), keys, "left")
        .withColumn(_SALT, F.pmod(F.xxhash64(spread_by), F.coalesce(F.col(_SALTS), F.lit(1))).cast("int"))
        .drop(_SALTS)
    )
    repeated = (
        lookup.join(F.broadcast(heavy), keys, "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_SALTS), F.lit(1)) - 1)))
        .drop(_SALTS)
    )
    return sliced.join(repeated, keys + [_SALT]).drop(_SALT)
