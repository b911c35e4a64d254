"""Choice of the queries that are evaluated."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

from rankloom.session import materialise


def eligible_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries with at least one relevant document."""
    return queries.join(qrels.select("qid"), "qid", "left_semi")


def sample_queries(queries: DataFrame, limit: int, seed: int) -> DataFrame:
    """``limit`` queries without replacement; all of them if the limit is 0, below, or too large.

    Queries are ordered by a seeded hash of their id, so the choice depends neither on
    partitioning nor on row order.
    """
    if limit <= 0:
        return queries
    ticket = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("qid").cast("string")))
    return queries.orderBy(ticket, F.col("qid")).limit(limit)


def with_ordinal(rows: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """``rows`` with their number, from 0, in the stated order; rows that are equal in it in any order.

    Rows are dealt to tasks in ranges of the order, numbered there and written; the rows before a range are the
    sum of the ranges before it. No task sees more than a range, and the driver one number per range.
    """
    placed = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    # Within a partition this number counts up from 0 in its lower 33 bits.
    number = F.monotonically_increasing_id()
    placed = placed.withColumns(
        {"__range": F.shiftright(number, 33).cast("int"), name: number.bitwiseAND(F.lit((1 << 33) - 1))}
    )
    written = materialise(placed, "numbered-rows")
    counts = {r["__range"]: r["n"] for r in written.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, before = [], 0
    for part in sorted(counts):
        starts.append((part, before))
        before += counts[part]
    table = written.sparkSession.createDataFrame(starts, "__range int, __before long")
    return written.join(F.broadcast(table), "__range").withColumn(name, F.col(name) + F.col("__before")).select(
        *[F.col(f"`{c}`") for c in rows.columns], name
    )


def draw_ordinals(n: int, limit: int, seed: int) -> list[int]:
    """``limit`` different numbers below ``n``, all of them if the limit is 0, below, or too large.

    The j-th try is the first 32 bits of the MD5 of "seed:j" modulo n; tries go on until there are enough.
    """
    if limit <= 0 or limit >= n:
        return list(range(n))
    drawn: dict[int, None] = {}
    attempt = 0
    while len(drawn) < limit:
        drawn.setdefault(int(hashlib.md5(f"{seed}:{attempt}".encode()).hexdigest()[:8], 16) % n)
        attempt += 1
    return list(drawn)


def sample_by_ordinal(queries: DataFrame, limit: int, seed: int) -> DataFrame:
    """``limit`` queries without replacement, drawn by their place in the order of their ids.

    The driver draws places, not ids, so it holds as many numbers as are asked for.
    """
    numbered = with_ordinal(queries, "qid", "text")
    if limit <= 0:
        return numbered.drop("ordinal")
    drawn = draw_ordinals(numbered.count(), limit, seed)
    places = queries.sparkSession.createDataFrame([(n,) for n in drawn], "ordinal long")
    return numbered.join(F.broadcast(places), "ordinal", "left_semi").drop("ordinal")
