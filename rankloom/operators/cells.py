"""Vector search over cells: exact, leaving out cells that cannot hold any of the first k.

Centres are fitted by k-means on a bounded sample of the vectors; every vector goes to its nearest centre.
A cell keeps its centre and its radius, the largest distance of any of its vectors. No inner product in a
cell exceeds ``q . centre + |q| * radius``, by the triangle inequality, so a cell whose bound is below the k-th
best score found so far is not read.

A search looks at the cells whose centres score best for a query, takes the k-th best score from there as
the query's floor, and then at all other cells whose bound reaches it. With ``probes`` only that many cells are
looked at for each query; the run is then no longer exact, and :func:`recall` says how much of it is there.

Within a cell, products are formed in single precision first. Only pairs that may reach the query's floor, by the
largest error that those products can have, are scored in double, so the run is that of double products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rankloom.config import DenseConfig
from rankloom.functions.guards import positive_k
from rankloom.operators.dense import _TILE_QUERIES, _Best, _matrix, _slice_count
from rankloom.operators.ranking import top_k
from rankloom.schemas import run_schema
from rankloom.session import materialise

# Vectors that centres are fitted on, chosen by hash of their id; all vectors are put in cells.
SAMPLE = 20_000
ROUNDS = 8
# Cells whose vectors give a query its floor.
FIRST = 2
_BLOCK = 8192
# Bounds and floors are compared with this part of room, for rounding in single precision.
_SLACK = 1e-5
# Vectors that are sifted with a tile of queries at a time; more where k is large.
_PIECE = 1024
# Where more than one of so many pairs may reach a floor, all are scored in double.
_SPARSE = 16
# Pairs that a scan's tasks share; the queries of a scan with more of them are dealt over several rounds of tasks.
_PAIRS = 1 << 32
_MOST_SHARES = 16
_LARGEST = float(np.finfo(np.float32).max)


@dataclass(frozen=True)
class CellIndex:
    """``vectors(cell, doc_id, embedding)``, stored by cell, and one row per cell in use:
    its number, centre, radius and number of vectors."""

    vectors: DataFrame
    cells: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    counts: np.ndarray


@dataclass(frozen=True)
class CellRun:
    """A ranked run, and how many of all (query, cell) pairs were looked at."""

    run: DataFrame
    looked_at: int
    pairs: int

    @property
    def skipped(self) -> float:
        return 1.0 - self.looked_at / self.pairs if self.pairs else 0.0


def fit_centres(sample: np.ndarray, cells: int, seed: int = 3) -> np.ndarray:
    """At most ``cells`` centres of a sample, by k-means; fewer where fewer vectors differ."""
    random = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    centres = distinct[random.choice(len(distinct), min(cells, len(distinct)), replace=False)] if len(distinct) else distinct
    for _ in range(ROUNDS if len(centres) > 1 else 0):
        own = _nearest(sample, centres)[0]
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        used = counts > 0
        centres = np.where(used[:, None], sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of the nearest centre of each row."""
    own = np.empty(len(rows), np.int64)
    half = (centres * centres).sum(axis=1) / 2
    for start in range(0, len(rows), _BLOCK):
        own[start : start + _BLOCK] = (rows[start : start + _BLOCK] @ centres.T - half).argmax(axis=1)
    return own, np.sqrt(((rows - centres[own]) ** 2).sum(axis=1))


def assign(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``(cell, doc_id, embedding, distance)``. Vectors with parts that are no finite numbers are left out, as no
    search finds them."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    key = vectors.schema["doc_id"]
    schema = T.StructType(
        [T.StructField("cell", T.IntegerType()), key, vectors.schema["embedding"], T.StructField("distance", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = shared.value
        for batch in batches:
            rows = _matrix(batch.column("embedding"))
            good = np.isfinite(rows).all(axis=1) if len(rows) else np.zeros(0, bool)
            if not good.any():
                continue
            if rows.shape[1] != middle.shape[1]:
                raise ValueError(f"a vector of dimension {rows.shape[1]} cannot go to centres of {middle.shape[1]}")
            kept = batch.filter(pa.array(good))
            own, distance = _nearest(rows[good], middle)
            columns = [pa.array(own.astype(np.int32)), kept.column("doc_id"), kept.column("embedding"), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return vectors.select("doc_id", "embedding").mapInArrow(run, schema)


def write_cells(spark: SparkSession, vectors: DataFrame, path: str, cells: int = 64, sample: int = SAMPLE, seed: int = 3) -> CellIndex:
    """Put ``vectors(doc_id, embedding)`` in about ``cells`` cells at ``path``, replacing what is there."""
    total = vectors.count()
    share = min(1.0, 1.2 * sample / max(1, total))
    near = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    taken = vectors.where(near).select("embedding").limit(2 * sample).toArrow()
    rows = _matrix(taken["embedding"]) if taken.num_rows else np.zeros((0, 1))
    centres = fit_centres(rows[np.isfinite(rows).all(axis=1)], cells, seed)
    if not len(centres):
        centres = np.zeros((1, rows.shape[1] if rows.size else 1))
    # By cell and hash, so that a cell with very many vectors is shared by tasks.
    placed = assign(vectors, centres).repartitionByRange(F.col("cell"), F.xxhash64("doc_id"))
    placed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    written = _vectors(spark, path, vectors.schema["doc_id"].dataType)
    found = written.groupBy("cell").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n")).orderBy("cell")
    middle = spark.createDataFrame([(n, [float(x) for x in c]) for n, c in enumerate(centres)], "cell int, centre array<double>")
    # A null column keeps the type of the ids, also where there is no vector.
    key = F.lit(None).cast(vectors.schema["doc_id"].dataType).alias("doc_id")
    middle.join(F.broadcast(found), "cell").select("*", key).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return load_cells(spark, path)


def _vectors(spark: SparkSession, path: str, key: T.DataType) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("doc_id", key),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("distance", T.DoubleType()),
            T.StructField("cell", T.IntegerType()),
        ]
    )
    return spark.read.schema(schema).parquet(f"{path}/vectors")


def load_cells(spark: SparkSession, path: str) -> CellIndex:
    rows = spark.read.parquet(f"{path}/cells")
    vectors = _vectors(spark, path, rows.schema["doc_id"].dataType).select("cell", "doc_id", "embedding")
    table = rows.orderBy("cell").toArrow()
    centres = _matrix(table["centre"]) if table.num_rows else np.zeros((0, 0))
    return CellIndex(vectors, table["cell"].to_numpy(), centres, table["radius"].to_numpy(), table["n"].to_numpy())


def cell_top_k(
    queries: DataFrame, index: CellIndex, k: int, probes: int | None = None, config: DenseConfig = DenseConfig()
) -> CellRun:
    """Ranked run of the ``k`` vectors with the largest inner product, as :func:`dense_top_k` gives it.

    Queries are answered slice by slice, as there. With ``probes`` only so many cells are read per query.
    """
    positive_k(k)
    schema = run_schema(queries.schema["qid"].dataType, index.vectors.schema["doc_id"].dataType)
    spark = queries.sparkSession
    if not len(index.cells):
        return CellRun(top_k(spark.createDataFrame([], schema), k), 0, 0)
    asked = materialise(queries.select("qid", "embedding"), "query-vectors")
    # A query also takes one byte per cell.
    count = max(1, _slice_count(asked, index.centres.shape[1], max(k, len(index.cells) // 64), config.broadcast_bytes))
    part = F.pmod(F.xxhash64("qid"), F.lit(count))
    runs, looked_at, pairs = [], 0, 0
    for number in range(count):
        table = (asked.where(part == number) if count > 1 else asked).toArrow()
        if not table.num_rows:
            continue
        ids, matrix = table["qid"].combine_chunks(), _matrix(table["embedding"])
        rows, looked = _search(index, ids, matrix, k, probes, schema)
        # All rows of a qid are in one slice.
        ranked = top_k(rows, k)
        runs.append(materialise(ranked, "cells-slice") if count > 1 else ranked)
        looked_at, pairs = looked_at + looked, pairs + len(ids) * len(index.cells)
    found = top_k(spark.createDataFrame([], schema), k) if not runs else runs[0]
    for more in runs[1:]:
        found = found.unionByName(more)
    return CellRun(found, looked_at, pairs)


def _search(
    index: CellIndex, ids: pa.Array, matrix: np.ndarray, k: int, probes: int | None, schema: T.StructType
) -> tuple[DataFrame, int]:
    """Rows that hold the first k of every query, and the number of (query, cell) pairs looked at."""
    centre_scores = matrix @ index.centres.T
    order = np.argsort(-centre_scores, axis=1, kind="stable")
    # As many cells as it takes for k vectors, and FIRST at least.
    filled = np.cumsum(index.counts[order], axis=1)
    first = np.maximum(FIRST, 1 + (filled < k).sum(axis=1))
    if probes is not None:
        first = np.full(len(ids), probes)
    wanted = np.zeros(centre_scores.shape, bool)
    np.put_along_axis(wanted, order, np.arange(len(index.cells))[None, :] < first[:, None], axis=1)
    floors = np.full(len(ids), -np.inf)
    begun = _scan(index, ids, matrix, wanted, floors, k, schema)
    if probes is not None or wanted.all():
        return begun, int(wanted.sum())
    begun = materialise(top_k(begun, k), "cells-first")
    kth = begun.where(F.col("rank") == k).select("qid", "score").toArrow()
    begun = begun.drop("rank")
    if kth.num_rows:
        # Also where a qid comes again.
        at = pc.index_in(ids, value_set=kth["qid"].combine_chunks())
        known = at.is_valid().to_numpy(zero_copy_only=False)
        floors[known] = kth["score"].to_numpy()[at.drop_null().to_numpy()]
    lengths = np.linalg.norm(matrix, axis=1)
    room = lengths[:, None] * index.radii[None, :]
    bound = centre_scores + room + _SLACK * (np.abs(centre_scores) + room)
    more = ~wanted & (bound >= (floors - _SLACK * np.abs(np.where(np.isfinite(floors), floors, 0.0)))[:, None])
    if not more.any():
        return begun, int(wanted.sum())
    return begun.unionByName(_scan(index, ids, matrix, more, floors, k, schema)), int(wanted.sum() + more.sum())


def _scan(
    index: CellIndex, ids: pa.Array, matrix: np.ndarray, wanted: np.ndarray, floors: np.ndarray, k: int, schema: T.StructType
) -> DataFrame:
    """At most k rows per query, cell and task, of the cells that a query wants. Other cells are not read.

    A task holds one cell at a time, and the scores of a piece of a block of vectors with one tile of queries."""
    used = np.flatnonzero(wanted.any(axis=0))
    place = {int(index.cells[c]): c for c in used}
    context = index.vectors.sparkSession.sparkContext
    shared = context.broadcast((ids, matrix, wanted, place, floors - np.abs(np.where(np.isfinite(floors), floors, 0.0)) * _SLACK))
    shares = int(min(_MOST_SHARES, max(1, -(-int(wanted.sum(axis=0) @ index.counts) // _PAIRS))))
    rows = index.vectors.where(F.col("cell").isin([int(index.cells[c]) for c in used])).select("cell", "doc_id", "embedding")
    found = rows.mapInArrow(_scanner(shared, k, 0, shares), schema)
    for share in range(1, shares):
        found = found.unionByName(rows.mapInArrow(_scanner(shared, k, share, shares), schema))
    return found


def _scanner(shared: Broadcast, k: int, share: int, shares: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does for one of ``shares`` equal parts of the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, who, where, low = shared.value
        with np.errstate(over="ignore", invalid="ignore"):
            queries = _Queries(asked, asked.astype(np.float32), np.linalg.norm(asked, axis=1))
        # A query with parts that are no finite numbers finds nothing.
        finite = np.isfinite(asked).all(axis=1)
        # What a query has found in a cell raises its floor in those to come.
        low = low.astype(np.float32)
        space = np.empty(_TILE_QUERIES * _BLOCK, np.float32)
        open_cell, tiles = None, []
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            # A task's rows come cell by cell; where a cell comes again, it adds its k best a second time.
            starts = np.concatenate(([0], np.flatnonzero(np.diff(cells)) + 1)) if len(cells) else []
            for start, stop in zip(starts, np.append(starts[1:], len(cells)), strict=True):
                if cells[start] != open_cell:
                    yield from _kept(tiles, names, low)
                    open_cell = cells[start]
                    chosen = np.flatnonzero(who[:, where[int(open_cell)]] & finite)[share::shares]
                    tiles = [_tile(chosen[t : t + _TILE_QUERIES], low, k) for t in range(0, len(chosen), _TILE_QUERIES)]
                for first in range(start, stop, _BLOCK):
                    part = batch.slice(first, min(_BLOCK, stop - first))
                    rows = _matrix(part.column("embedding"))
                    single, longest = rows.astype(np.float32), float(np.linalg.norm(rows, axis=1).max())
                    for chosen, best in tiles:
                        _sift(best, part.column("doc_id"), rows, single, longest, queries.of(chosen), space)
        yield from _kept(tiles, names, low)

    return run


@dataclass(frozen=True)
class _Queries:
    """Query vectors in double and in single precision, and their lengths."""

    exact: np.ndarray
    single: np.ndarray
    lengths: np.ndarray

    def of(self, chosen: np.ndarray) -> _Queries:
        return _Queries(self.exact[chosen], self.single[chosen], self.lengths[chosen])


@np.errstate(over="ignore", invalid="ignore")
def _sift(
    best: _Best, ids: pa.Array, rows: np.ndarray, single: np.ndarray, longest: float, tile: _Queries, space: np.ndarray
) -> None:
    """Let a tile's best see the scores of ``rows``, none of them longer than ``longest``; ``space`` is written over.

    A product of single numbers is off by ``dim * 2 ** -24`` of the lengths' product at most, and by half a place of the
    query's and of the floor's; twice that is left as room. What is no number there, or too large, is scored in double.
    """
    step = min(_BLOCK, max(_PIECE, 4 * best.k))
    error = (rows.shape[1] + 4) * 2.0**-23 * tile.lengths * longest + rows.shape[1] * 1e-37
    for first in range(0, len(rows), step):
        piece = single[first : first + step]
        scores = space[: len(tile.single) * len(piece)].reshape(len(tile.single), len(piece))
        np.matmul(tile.single, piece.T, out=scores)
        floor = np.minimum(best.floor.astype(np.float64), _LARGEST)
        low = (floor - error - np.abs(floor) * 2.0**-22).astype(np.float32)[:, None]
        # Compared so that what is no number counts as near.
        near = np.flatnonzero(~(scores.max(axis=1, keepdims=True) < low))
        if not len(near):
            continue
        query, row = np.nonzero(~(scores[near] < low[near]))
        if len(query) > scores.size // _SPARSE:
            best.add(ids.slice(first, step), rows[first : first + step] @ tile.exact.T)
        else:
            query, row = near[query], row + first
            best.hold(query, ids.take(pa.array(row)), np.einsum("ij,ij->i", rows[row], tile.exact[query]))


def _tile(chosen: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, _Best]:
    """Some of the queries that want a cell, and the best they have seen there."""
    best = _Best(len(chosen), k)
    best.floor = low[chosen]
    return chosen, best


def _kept(tiles: list[tuple[np.ndarray, _Best]], names: pa.Array, low: np.ndarray) -> Iterator[pa.RecordBatch]:
    for chosen, best in tiles:
        yield from best.batches(names.take(pa.array(chosen)))
        low[chosen] = best.floor


def recall(run: DataFrame, exact: DataFrame) -> DataFrame:
    """``(queries, found, recall)``: how much of the exact run another one of the same queries has."""
    same = exact.select("qid", "doc_id").join(run.select("qid", "doc_id", F.lit(1).alias("hit")), ["qid", "doc_id"], "left")
    return same.agg(
        F.count_distinct("qid").alias("queries"),
        F.count("hit").alias("found"),
        (F.count("hit") / F.count(F.lit(1))).alias("recall"),
    )
