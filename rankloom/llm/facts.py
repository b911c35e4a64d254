"""Taking what was found out about some rows back to them, moving only the rows in question.

Facts are told by two hashes of a row's contents. A Bloom filter of the facts lets all other rows stay where they
are; the rest meet the facts in a join. Rows of the same contents, however many, are dealt over slices of
``SLICE_ROWS``, with the facts once per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankloom.llm import bloom
from rankloom.llm.common import free_name
from rankloom.operators.joins import heavy_keys

# Rows of the same contents that one task may get.
SLICE_ROWS = 1 << 14


def row_key(seed: int, *fields: str) -> Column:
    """A hash of some columns; nulls are told apart from other values."""
    columns = [F.col(f"`{c}`") for c in fields]
    return F.xxhash64(F.lit(seed), *[c.isNull() for c in columns], *columns)


def spread(
    rows: DataFrame, facts: DataFrame, fields: tuple[str, ...], payload: str, slice_rows: int = SLICE_ROWS
) -> tuple[DataFrame, DataFrame]:
    """``(others, met)``: rows without a fact, and rows with column ``payload``, null where there is none.

    ``facts(row1, row2, copies, <payload>)`` has been written before: ``row_key(1)`` and ``row_key(2)`` of
    ``fields``, and the number of rows they are of. The name of the payload must be free in ``rows``.
    """
    columns = [F.col(f"`{c}`") for c in rows.columns]
    one, two, maybe, number = (free_name(rows, n) for n in ("row1", "row2", "possible", "number"))
    marked = rows.withColumns(
        {one: row_key(1, *fields), two: row_key(2, *fields), number: F.monotonically_increasing_id()}
    )
    blocks = bloom.block_count(facts.count())
    marked = bloom.mark(marked, one, bloom.build(facts, "row1", blocks), blocks, maybe)
    others = marked.where(~F.col(maybe)).select(*columns)

    heavy = heavy_keys(facts, ["row1", "row2"], "copies", slice_rows)
    heavy = F.broadcast(heavy.toDF("__r1", "__r2", "__salts"))  # at most as many as heavy_keys allows
    parts = F.coalesce(F.col("__salts"), F.lit(1))
    same = (F.col(one) == F.col("__r1")) & (F.col(two) == F.col("__r2"))
    salted = marked.where(F.col(maybe)).join(heavy, same, "left").withColumn(
        "__salt", F.pmod(F.xxhash64(number), parts)
    ).drop("__r1", "__r2", "__salts")
    told = facts.select(F.col("row1").alias("__d1"), F.col("row2").alias("__d2"), F.col(payload))
    told = (
        told.join(heavy, (F.col("__d1") == F.col("__r1")) & (F.col("__d2") == F.col("__r2")), "left")
        .select("__d1", "__d2", payload, F.explode(F.sequence(F.lit(0), parts - 1)).alias("__s"))
    )
    fits = (F.col(one) == F.col("__d1")) & (F.col(two) == F.col("__d2")) & (F.col("__salt") == F.col("__s"))
    return others, salted.join(told, fits, "left").select(*columns, payload)

