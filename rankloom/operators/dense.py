"""Exact vector search: every query against every vector, k best kept where the vectors lie.

Vectors are never moved. The query vectors go to them in slices of bounded size, one pass over the
vectors per slice; a task multiplies blocks of vectors with tiles of the slice and passes on at most k
rows per query. Pairs are never rows.

Searching starts jobs while the plan is built: the query vectors are written once, measured and fetched
slice by slice, and with more than one slice the passes themselves run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.types import StructType

from rankloom.config import DenseConfig
from rankloom.functions.guards import positive_k
from rankloom.functions.vectors import l2_normalize
from rankloom.operators.places import Asked, plain_ids
from rankloom.operators.ranking import top_k
from rankloom.schemas import run_schema
from rankloom.session import materialise

# Vectors and queries of one product: 4 million scores, 32 MB in double precision.
_BLOCK_VECTORS = 8192
_TILE_QUERIES = 512
# Queries of one product where every score is passed on.
_STREAMED_QUERIES = 16
# Bytes a task keeps per query and place: score, rank key and id.
_KEPT_BYTES = 64
# Single scores that may wait for a tile, where k asks for fewer.
_WAITING = 4096


def normalized(vectors: DataFrame) -> DataFrame:
    """Unit vectors, so that the inner product is the cosine. Zero vectors stay zero."""
    return vectors.withColumn("embedding", l2_normalize(F.col("embedding")))


def dimension_counts(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``(dim, n_vectors, fits)``: vectors by dimension, and whether all queries have that dimension."""
    asked = dimensions(queries).select("min_dim", "max_dim").first()
    fits = F.lit(asked.min_dim == asked.max_dim) & (F.col("dim") == F.lit(asked.min_dim))
    return (
        vectors.groupBy(F.size("embedding").cast("int").alias("dim"))
        .agg(F.count(F.lit(1)).alias("n_vectors"))
        .select("dim", "n_vectors", F.coalesce(fits, F.lit(False)).alias("fits"))
    )


def mismatches(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``(side, id, dim, expected)``: rows of either side that the usual dimension of the index does not fit.

    The usual dimension is the most frequent one of the index, the smaller of equally frequent ones; a missing
    vector has dimension -1. Ids are told as text, as both sides may have their own type.
    """
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    counts = vectors.groupBy(size.alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    # One row per dimension that occurs, then one row.
    usual = counts.agg(F.max_by("dim", F.struct("n", -F.col("dim"))).alias("expected"))
    sides = vectors.select(F.lit("index").alias("side"), F.col("doc_id").cast("string").alias("id"), size.alias("dim")).unionByName(
        queries.select(F.lit("query").alias("side"), F.col("qid").cast("string").alias("id"), size.alias("dim"))
    )
    expected = usual.first()[0]
    return sides.where(F.col("dim") != F.lit(expected)).withColumn("expected", F.lit(expected).cast("int"))


def dimensions(vectors: DataFrame) -> DataFrame:
    """One row: number of vectors, smallest and largest dimension."""
    size = F.size("embedding")
    return vectors.agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.min(size).cast("int").alias("min_dim"),
        F.max(size).cast("int").alias("max_dim"),
    )


def check_dimensions(index: DataFrame, queries: DataFrame) -> None:
    """Raise if the index and the query vectors differ in dimension. Empty sides fit anything."""
    index_dims = dimensions(index).first()
    query_dims = dimensions(queries).first()
    found = {d for row in (index_dims, query_dims) for d in (row.min_dim, row.max_dim) if d is not None}
    if len(found) > 1:
        raise ValueError(
            f"{index_dims.n_vectors} index vectors of dimension {_span(index_dims)} cannot be searched with "
            f"{query_dims.n_vectors} query vectors of dimension {_span(query_dims)}"
        )


def _span(row) -> str:
    return str(row.min_dim) if row.min_dim == row.max_dim else f"{row.min_dim} to {row.max_dim}"


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a double matrix, without a Python object per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) == 0:
        return np.zeros((0, 0))
    if column.null_count or sizes.min() != sizes.max():
        raise ValueError("vectors are missing or differ in dimension")
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(sizes), int(sizes[0]))


class _Best:
    """The k best (score, id) of each query of a tile seen so far, ties by the smaller id.

    Scores that are no finite numbers, from vectors with such parts, are never kept.
    """

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.floor = np.full(n_queries, -np.inf, dtype=np.float32)
        self.kept: pa.Table | None = None
        self.waiting: list[pa.Table] = []
        self.room = max(k * n_queries, _WAITING)

    def add(self, ids: pa.Array, scores: np.ndarray) -> None:
        scores = np.where(np.isfinite(scores), scores, -np.inf)
        ranked = scores.astype(np.float32)
        if len(ranked) >= self.k:
            kth = np.partition(ranked, len(ranked) - self.k, axis=0)[len(ranked) - self.k]
            self.floor = np.maximum(self.floor, kth)
        row, query = np.nonzero((ranked >= self.floor) & (ranked > -np.inf))
        if len(row):
            self._merge([_rows(query, ranked[row, query], ids.take(pa.array(row)), scores[row, query])])

    def hold(self, query: np.ndarray, ids: pa.Array, scores: np.ndarray) -> None:
        """Single scores of a query each. They wait until there are many, and raise no floor till then."""
        ranked = np.where(np.isfinite(scores), scores, -np.inf).astype(np.float32)
        good = np.flatnonzero((ranked >= self.floor[query]) & (ranked > -np.inf))
        if len(good):
            self.waiting.append(_rows(query[good], ranked[good], ids.take(pa.array(good)), scores[good]))
            if sum(block.num_rows for block in self.waiting) >= self.room:
                self._settle()

    def _settle(self) -> None:
        if self.waiting:
            blocks, self.waiting = self.waiting, []
            self._merge(blocks)

    def _merge(self, blocks: list[pa.Table]) -> None:
        both = pa.concat_tables(blocks if self.kept is None else [self.kept, *blocks])
        both = both.sort_by([("query", "ascending"), ("ranked", "descending"), ("id", "ascending")])
        query = both["query"].to_numpy()
        first = np.searchsorted(query, query, side="left")
        place = np.arange(len(query)) - first
        self.kept = both.filter(pa.array(place < self.k)).combine_chunks()
        last = place == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], both["ranked"].to_numpy()[last])

    def batches(self, query_ids: pa.Array) -> Iterator[pa.RecordBatch]:
        self._settle()
        if self.kept is None:
            return
        kept = self.kept
        table = pa.table(
            {
                "qid": query_ids.take(kept["query"].combine_chunks()),
                "doc_id": kept["id"].combine_chunks(),
                "score": kept["score"].combine_chunks(),
            }
        )
        yield from table.to_batches()


def _rows(query: np.ndarray, ranked: np.ndarray, ids: pa.Array, scores: np.ndarray) -> pa.Table:
    return pa.table({"query": query, "ranked": ranked, "id": ids, "score": scores})


def inner_product_scores(queries: DataFrame, vectors: DataFrame, k: int, config: DenseConfig = DenseConfig()) -> DataFrame:
    """At most k rows per query and partition of vectors; the overall k best are among them."""
    schema = run_schema(queries.schema["qid"].dataType, vectors.schema["doc_id"].dataType)
    spark = queries.sparkSession
    one = vectors.select(F.size("embedding").alias("dim")).first()
    if one is None:
        return spark.createDataFrame([], schema)
    asked = materialise(queries.select("qid", "embedding"), "query-vectors")
    keeps = k <= _BLOCK_VECTORS or k < _largest_part(vectors)
    # A task that passes on all that it scores keeps nothing, so k does not ask for more slices.
    count = _slice_count(asked, one.dim, k if keeps else 0, config.broadcast_bytes)
    if count <= 1:
        return _scan(asked, vectors, k, schema, keeps)[0]
    part = F.pmod(F.xxhash64("qid"), F.lit(count))
    done = None
    for number in range(count):
        scores, shared = _scan(asked.where(part == number), vectors, k, schema, keeps)
        # One slice at a time is held, by the driver as by the executors.
        written = materialise(scores, "dense-slice")
        shared.unpersist()
        done = written if done is None else done.unionByName(written)
    return done


def _slice_count(asked: DataFrame, dim: int, k: int, limit: int) -> int:
    """Slices of the queries, so that vectors and kept rows of a slice stay near ``limit`` bytes."""
    size = F.size("embedding")
    row_bytes = size * 8 + F.octet_length(F.col("qid").cast("string")) + F.lit(_KEPT_BYTES * k)
    found = asked.agg(
        F.coalesce(F.sum(row_bytes.cast("bigint")), F.lit(0)).alias("bytes"),
        F.count(F.lit(1)).alias("n"),
        F.min(size).alias("least"),
        F.max(size).alias("most"),
    ).first()
    if found.n and not found.least == found.most == dim:
        raise ValueError(
            f"an index vector has dimension {dim}, but the {found.n} query vectors have {found.least} to {found.most}"
        )
    return max(1, min(found.n, -(-found.bytes // max(1, limit))))


def _largest_part(vectors: DataFrame) -> int:
    """Vectors of the partition that has most."""
    parts = vectors.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return parts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def _scan(
    asked: DataFrame, vectors: DataFrame, k: int, schema: StructType, keeps: bool = True
) -> tuple[DataFrame, Broadcast]:
    """One slice of queries, measured before, goes to every executor and meets all vectors there.

    Where it ``keeps`` nothing, for a k that no partition exceeds, a task passes on every score as it is formed.
    """
    table = asked.toArrow()
    query_ids = table["qid"].combine_chunks()
    shared = asked.sparkSession.sparkContext.broadcast((query_ids, _matrix(table["embedding"])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, query_matrix = shared.value
        starts = range(0, len(ids), _TILE_QUERIES)
        tiles = [(query_matrix[s : s + _TILE_QUERIES], _Best(len(query_matrix[s : s + _TILE_QUERIES]), k)) for s in starts]
        for batch in batches if len(ids) else ():
            matrix = _matrix(batch.column(1))
            if len(matrix) and matrix.shape[1] != query_matrix.shape[1]:
                raise ValueError(
                    f"index vectors of dimension {matrix.shape[1]} meet queries of {query_matrix.shape[1]}"
                )
            for first in range(0, len(matrix), _BLOCK_VECTORS):
                block, block_ids = matrix[first : first + _BLOCK_VECTORS], batch.column(0).slice(first, _BLOCK_VECTORS)
                if not keeps:
                    yield from _all_scores(ids, query_matrix, block_ids, block, schema)
                    continue
                for tile, best in tiles:
                    best.add(block_ids, block @ tile.T)
        for start, (_, best) in zip(starts, tiles, strict=True):
            yield from best.batches(ids.slice(start, _TILE_QUERIES))

    return vectors.select("doc_id", "embedding").mapInArrow(scan, schema), shared


def _all_scores(
    ids: pa.Array, query_matrix: np.ndarray, block_ids: pa.Array, block: np.ndarray, schema: StructType
) -> Iterator[pa.RecordBatch]:
    """The scores of a block with all queries, a few queries at a time; none that is no finite number."""
    for start in range(0, len(ids), _STREAMED_QUERIES):
        scores = query_matrix[start : start + _STREAMED_QUERIES] @ block.T
        query, row = np.nonzero(np.isfinite(scores))
        columns = [ids.take(pa.array(query + start)), block_ids.take(pa.array(row)), pa.array(scores[query, row])]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, config: DenseConfig = DenseConfig()) -> DataFrame:
    """Ranked run of the ``k`` vectors with the largest inner product, or fewer if there are fewer.

    Vectors with parts that are no finite numbers are not found by any query.
    """
    positive_k(k)
    return top_k(inner_product_scores(queries, vectors, k, config), k)


def dense_places(queries: DataFrame, vectors: DataFrame, pairs: DataFrame, config: DenseConfig = DenseConfig()) -> DataFrame:
    """``(qid, doc_id, rank)``: the places that ``pairs(qid, doc_id)`` have in the whole lists of ``queries``.

    Pairs of a document that no query finds are not there. The vectors are gone over twice per slice of queries:
    for the scores of the pairs, and to count what ranks before them.
    """
    schema = T.StructType([*run_schema(queries.schema["qid"].dataType, vectors.schema["doc_id"].dataType).fields[:2], T.StructField("rank", T.IntegerType())])
    spark = queries.sparkSession
    one = vectors.select(F.size("embedding").alias("dim")).first()
    if one is None:
        return spark.createDataFrame([], schema)
    most = pairs.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if not most:
        return spark.createDataFrame([], schema)
    asked = materialise(queries.select("qid", "embedding"), "query-vectors")
    count = max(1, _slice_count(asked, one.dim, most, config.broadcast_bytes))
    part, done = F.pmod(F.xxhash64("qid"), F.lit(count)), None
    for number in range(count):
        placed = materialise(
            _places(asked.where(part == number), vectors, pairs.where(part == number), schema) if count > 1 else _places(asked, vectors, pairs, schema),
            "dense-places",
        )
        done = placed if done is None else done.unionByName(placed)
    return done


def _places(asked: DataFrame, vectors: DataFrame, pairs: DataFrame, schema: T.StructType) -> DataFrame:
    spark, context = asked.sparkSession, asked.sparkSession.sparkContext
    table = asked.toArrow()
    names = table["qid"].combine_chunks()
    matrix = _matrix(table["embedding"])
    # One slice of pairs, as the queries' k best rows in a search.
    wanted = pairs.select("qid", "doc_id").join(asked.select("qid"), "qid", "left_semi")
    shared = context.broadcast((names, matrix))
    scored = vectors.select("doc_id", "embedding").join(F.broadcast(wanted), "doc_id").select("qid", "doc_id", "embedding")
    scores = scored.mapInArrow(lambda batches: _pair_scores(batches, shared.value), run_schema(*(schema[c].dataType for c in ("qid", "doc_id")))).toArrow()
    good = np.isfinite(scores["score"].to_numpy())
    scores = scores.filter(pa.array(good))
    if not scores.num_rows:
        return spark.createDataFrame([], schema)
    query = pc.index_in(scores["qid"], value_set=names).to_numpy()
    given = context.broadcast((query, scores["doc_id"].combine_chunks(), scores["score"].to_numpy()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, query_matrix = shared.value
        found = Asked(*given.value, len(ids))
        for batch in batches:
            rows = _matrix(batch.column(1))
            for first in range(0, len(rows), _BLOCK_VECTORS):
                block, block_ids = rows[first : first + _BLOCK_VECTORS], plain_ids(batch.column(0).slice(first, _BLOCK_VECTORS))
                for start in range(0, len(ids), _TILE_QUERIES):
                    products = block @ query_matrix[start : start + _TILE_QUERIES].T
                    for place in range(products.shape[1]):
                        found.add(start + place, block_ids, products[:, place])
        before = found.before()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(before))), pa.array(before)], names=["row", "before"])

    counts = vectors.select("doc_id", "embedding").mapInArrow(count, "row long, before long")
    total = counts.groupBy("row").agg(F.sum("before").alias("before"))
    scores = scores.append_column("row", pa.array(np.arange(scores.num_rows)))
    numbered = spark.createDataFrame(scores.select(["row", "qid", "doc_id"]), T.StructType([T.StructField("row", T.LongType()), *schema.fields[:2]]))
    return numbered.join(total, "row").select("qid", "doc_id", (F.col("before") + 1).cast("int").alias("rank"))


def _pair_scores(batches: Iterator[pa.RecordBatch], asked: tuple[pa.Array, np.ndarray]) -> Iterator[pa.RecordBatch]:
    names, matrix = asked
    for batch in batches:
        if batch.num_rows:
            rows = _matrix(batch.column(2))
            query = pc.index_in(batch.column(0), value_set=names).to_numpy(zero_copy_only=False)
            score = np.einsum("ij,ij->i", rows, matrix[query])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["qid", "doc_id", "score"])


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int, config: DenseConfig = DenseConfig()) -> DataFrame:
    """As :func:`dense_top_k` on unit vectors."""
    return dense_top_k(normalized(queries), normalized(vectors), k, config)
