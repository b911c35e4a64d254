"""Text to vectors: a hook for any batch encoder, and a hashed encoder as the default."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.types import StructType

from rankloom.config import DenseConfig
from rankloom.functions.scores import inverse_document_frequency
from rankloom.functions.text import compose, term_bucket
from rankloom.operators.joins import SLICE_ROWS, heavy_keys, salted_join
from rankloom.operators.lexical import TextIndex, content_frequency, query_bytes, query_terms
from rankloom.operators.postings_blocks import BlockSet, flat, with_shard
from rankloom.schemas import vectors_schema

BatchEncoder = Callable[[Sequence[str]], np.ndarray]

# Texts that wait for others of their length, and the characters of them that may wait.
WAITING_TEXTS = 4096
WAITING_CHARS = 1 << 24
# What a row of the vocabulary takes besides its term, in a table that is broadcast.
_TERM_BYTES = 128
# Of the bytes that may be broadcast, the part for frequent terms where not all fit.
_COMMON_PART = 4
# Up to so many places of vectors per posting, sums are formed in a table of all places.
_CELLS_PER_POSTING = 4


def document_text(corpus: DataFrame) -> DataFrame:
    """The text a document is encoded from: title and body in one string."""
    return corpus.select("doc_id", compose(F.col("title"), F.col("text")).alias("text"))


def normalize_rows(matrix: np.ndarray) -> np.ndarray:
    """Unit rows; zero rows stay zero."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix, dtype=np.float64))
    norms[norms == 0.0] = 1.0
    return matrix / norms[:, None]


def _vector_batch(key: str, keys: pa.Array, matrix: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    values = np.ascontiguousarray(matrix, dtype=np.float32)
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))
    return pa.RecordBatch.from_arrays([keys.cast(schema.field(0).type), vectors], names=[key, "embedding"])


def encode(texts: DataFrame, encoder: BatchEncoder, config: DenseConfig = DenseConfig(), key: str = "doc_id") -> DataFrame:
    """Encode ``texts(key, text)`` where the rows lie, ``batch_size`` texts at a time.

    ``encoder`` maps a list of texts to a matrix with one row per text. It is shipped to the
    executors, so a model should be loaded there on first use.
    """
    size, normalize = config.batch_size, config.normalize
    schema = vectors_schema(key, texts.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                matrix = np.asarray(encoder(part.column(1).to_pylist()), dtype=np.float32)
                if normalize:
                    matrix = normalize_rows(matrix)
                keys = part.column(0)
                yield _vector_batch(key, keys, matrix, pa.schema([(key, keys.type)]))

    return texts.select(key, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def like_length_batches(lengths: Sequence[int], budget: int, most: int) -> list[list[int]]:
    """Places in batches of at most ``most``, each padded to its longest within ``budget``, long ones first.

    One that is longer than the budget is a batch of its own.
    """
    order = sorted(range(len(lengths)), key=lambda n: (-lengths[n], n))
    batches: list[list[int]] = []
    for place in order:
        # The first of a batch is its longest.
        if batches and len(batches[-1]) < most and max(1, lengths[batches[-1][0]]) * (len(batches[-1]) + 1) <= budget:
            batches[-1].append(place)
        else:
            batches.append([place])
    return batches


def encode_by_length(
    texts: DataFrame,
    encoder: BatchEncoder,
    budget: int,
    config: DenseConfig = DenseConfig(),
    key: str = "doc_id",
    length: Callable[[str], int] = len,
) -> DataFrame:
    """As :func:`encode`, with batches of texts of like length, so that padding to the longest stays small.

    Texts wait in a buffer of at most ``WAITING_TEXTS`` and about ``WAITING_CHARS``; a batch has at most
    ``config.batch_size`` texts and, with each as long as its longest, at most ``budget`` units of ``length``.
    Rows come out in the order in which they came in.
    """
    size, normalize = config.batch_size, config.normalize
    schema = vectors_schema(key, texts.schema[key].dataType)

    def encoded(keys: list[pa.Array], waiting: list[str]) -> pa.RecordBatch:
        rows: list[np.ndarray] = [None] * len(waiting)
        for batch in like_length_batches([length(text) for text in waiting], budget, size):
            matrix = np.asarray(encoder([waiting[n] for n in batch]), dtype=np.float32)
            if normalize:
                matrix = normalize_rows(matrix)
            for place, row in zip(batch, matrix, strict=True):
                rows[place] = row
        joined = pa.concat_arrays(keys)
        return _vector_batch(key, joined, np.stack(rows), pa.schema([(key, joined.type)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, waiting, held = [], [], 0
        for batch in batches:
            for place, text in enumerate(batch.column(1)):
                keys.append(batch.column(0).slice(place, 1))
                waiting.append(text.as_py())
                held += len(waiting[-1])
                if len(waiting) >= WAITING_TEXTS or held >= WAITING_CHARS:
                    yield encoded(keys, waiting)
                    keys, waiting, held = [], [], 0
        if waiting:
            yield encoded(keys, waiting)

    return texts.select(key, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def content_idf(index: TextIndex) -> DataFrame:
    """``(term, df, idf)`` over whole documents."""
    idf = inverse_document_frequency(F.lit(index.n_docs), F.col("df"))
    return index.content_stats.select("term", "df", idf.alias("idf"))


def _common_terms(idf: DataFrame, limit: int) -> tuple[int | None, int]:
    """The least document frequency, a power of two, from which on the terms are to be broadcast, none if even the
    most frequent do not fit, and the postings of the terms below it. 1 if all terms fit ``limit`` bytes; else only
    a part of them is taken, as a driver holds it more than once."""
    size = F.octet_length("term") + F.lit(_TERM_BYTES)
    # One row per binary digit of the frequency.
    classes = idf.groupBy(F.floor(F.log2("df")).cast("int").alias("log")).agg(
        F.sum(size.cast("bigint")).alias("bytes"), F.sum("df").alias("rows")
    )
    found = sorted(classes.collect(), key=lambda row: -row.log)
    if sum(row.bytes for row in found) <= limit:
        return 1, 0
    held, least = 0, None
    for place, row in enumerate(found):
        held += row.bytes
        if held > limit // _COMMON_PART:
            return least, sum(rest.rows for rest in found[place:])
        least = 1 << row.log
    return 1, 0


def _rare_entries(
    frequencies: DataFrame, rare: DataFrame, common: DataFrame | None, least: int | None, key: str, weight: Column, rows: int, partitions: int | None
) -> DataFrame:
    """What the terms of ``rare`` add, by owner and place, if no term of ``common`` is among them. Only their own
    ``rows`` are moved: to the vocabulary, and with their place and weight back to their owner."""
    own = frequencies if common is None else frequencies.join(F.broadcast(common), "term", "left_anti")
    joined = _joined_rare(own, rare, least, F.col(key), rows)
    return joined.select(key, "bucket", weight.alias("value")).repartition(partitions or _rare_partitions(rare, rows), key)


def _rare_partitions(rare: DataFrame, rows: int) -> int:
    return max(int(rare.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // SLICE_ROWS))


def _joined_rare(own: DataFrame, rare: DataFrame, least: int | None, spread_by: Column, rows: int) -> DataFrame:
    """``own`` with the vocabulary ``rare``, whose terms have ``rows`` postings in all and fewer than ``least`` each."""
    if least is not None and least <= SLICE_ROWS:
        # No term has more rows than a slice.
        parts = _rare_partitions(rare, rows)
        return own.repartition(parts, "term").join(rare.repartition(parts, "term").hint("merge"), "term")
    return salted_join(own, rare, ["term"], heavy_keys(rare, ["term"], "df"), spread_by)


def hashed_vectors(
    frequencies: DataFrame,
    idf: DataFrame,
    owners: DataFrame,
    config: DenseConfig = DenseConfig(),
    key: str = "doc_id",
    frequency: str = "tf",
    small_frequencies: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Feature-hashed vectors: every term adds ``(1 + ln tf) * idf`` to one of ``dim`` places.

    ``frequencies(key, term, tf)`` is joined with the vocabulary table ``idf(term, df, idf)``. If
    the caller has measured the frequencies as small they are broadcast to the vocabulary; else
    the most frequent terms are broadcast, as many as fit, and only rows of other terms are shuffled, a
    term that has very many of them salted. ``owners(key)`` without a known term get a zero vector.
    ``partitions`` are those in which the frequencies lie by ``key``, if they do.
    """
    placed = idf.select("term", "df", "idf", term_bucket(F.col("term"), config.dim).alias("bucket"))
    weight = (F.lit(1.0) + F.log(F.col(frequency).cast("double"))) * F.col("idf")
    sides = []
    if small_frequencies:
        joined = placed.join(F.broadcast(frequencies), "term")
        sides.append(joined.select(key, "bucket", weight.alias("value")))
    else:
        least, rows = _common_terms(idf, config.broadcast_bytes)
        common = None
        if least is not None:
            common = placed if least == 1 else placed.where(F.col("df") >= least)
            joined = frequencies.join(F.broadcast(common.select("term", "idf", "bucket")), "term")
            sides.append(joined.select(key, "bucket", weight.alias("value")))
        if least != 1:
            rare = placed if least is None else placed.where(F.col("df") < least)
            known = None if common is None else common.select("term")
            sides.append(_rare_entries(frequencies, rare, known, least, key, weight, rows, partitions))
    # The entries of all owners are large, though an estimate may call them small.
    complete = owners.select(key)
    for place, side in enumerate(sides):
        # At most `dim` entries per owner: sums are formed before they are listed.
        sums = side.groupBy(key, "bucket").agg(F.sum("value").alias("value"))
        entries = sums.groupBy(key).agg(
            F.collect_list("bucket").alias(f"buckets{place}"), F.collect_list("value").alias(f"values{place}")
        )
        complete = complete.join(entries.hint("merge"), key, "left")
    return _scattered(complete, len(sides), config, key)


def _scattered(complete: DataFrame, n_sides: int, config: DenseConfig, key: str) -> DataFrame:
    """Vectors of the entries that every side lists: ``complete(key, buckets0, values0, ...)``."""
    dim, normalize = config.dim, config.normalize
    schema: StructType = vectors_schema(key, complete.schema[key].dataType)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = np.zeros((batch.num_rows, dim), dtype=np.float64)
            for side in range(n_sides):
                buckets, values = batch.column(1 + 2 * side), batch.column(2 + 2 * side)
                lengths = buckets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                rows = np.repeat(np.arange(batch.num_rows), lengths)
                # A place comes once per owner and side.
                matrix[rows, buckets.flatten().to_numpy(zero_copy_only=False)] += values.flatten().to_numpy(
                    zero_copy_only=False
                )
            if normalize:
                matrix = normalize_rows(matrix)
            keys = batch.column(0)
            yield _vector_batch(key, keys, matrix, pa.schema([(key, keys.type)]))

    listed = [f"{name}{side}" for side in range(n_sides) for name in ("buckets", "values")]
    return complete.select(key, *listed).mapInArrow(scatter, schema)


def hash_documents(index: TextIndex, corpus: DataFrame, config: DenseConfig = DenseConfig()) -> DataFrame:
    """Vectors of all documents, from the postings of the text index, or from its blocks where it has them."""
    key = index.postings.schema["doc_id"].dataType
    if len(index.blocks) == 1 and index.blocks[0].gone is None and corpus.schema["doc_id"].dataType == key:
        return _scattered(_block_entries(index.blocks[0], content_idf(index), corpus, config), 1, config, "doc_id")
    return hashed_vectors(content_frequency(index.postings), content_idf(index), corpus, config, partitions=index.buckets)


def _block_entries(found: BlockSet, idf: DataFrame, owners: DataFrame, config: DenseConfig) -> DataFrame:
    """The entries of :func:`hashed_vectors` for ``owners(doc_id)``, summed up shard by shard.

    Blocks of frequent terms, as many as are broadcast, stay where they lie. Those of other terms go to the
    vocabulary and, with their place and weight, back to their shard, where also the ids of the owners go.
    """
    key = owners.schema["doc_id"].dataType
    dim, shards = config.dim, len(found.shards)
    placed = idf.select("term", "df", "idf", term_bucket(F.col("term"), dim).alias("bucket"))
    blocks = found.blocks.select("shard", "term", "docs", "tfs")
    least, rows = _common_terms(idf, config.broadcast_bytes)
    columns = ["shard", "term", "docs", "tfs", "idf", "bucket"]
    common = placed.where(F.lit(False) if least is None else F.col("df") >= least)
    near = blocks.join(F.broadcast(common.select("term", "idf", "bucket")), "term").select(columns)
    # An owner is a row without a term.
    others = with_shard(owners.select("doc_id"), list(found.shards)).select(
        "shard",
        F.lit(None).cast("string").alias("term"),
        F.array("doc_id").alias("docs"),
        F.lit(None).cast("array<int>").alias("tfs"),
        F.lit(None).cast("double").alias("idf"),
        F.lit(None).cast("int").alias("bucket"),
    )
    if least != 1:
        rare = placed if least is None else placed.where(F.col("df") < least)
        own = blocks if least is None else blocks.join(F.broadcast(common.select("term")), "term", "left_anti")
        others = _joined_rare(own, rare, least, F.col("shard"), rows).select(columns).unionByName(others)
    schema = T.StructType(
        [
            T.StructField("doc_id", key),
            T.StructField("buckets0", T.ArrayType(T.IntegerType())),
            T.StructField("values0", T.ArrayType(T.DoubleType())),
        ]
    )

    def add_up(held: pa.Table, moved: pa.Table) -> pa.Table:
        given = moved["term"].is_null()
        asked = flat(moved.filter(given)["docs"])
        listed = pa.concat_tables([part.select(columns) for part in (held, moved.filter(pc.invert(given))) if part.num_rows] or [held.select(columns)])
        return _listed_entries(listed, asked, dim, schema.names)

    # Columns of its own, as both sides come from the same blocks.
    moved = others.toDF(*columns).repartition(shards, "shard")
    return near.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(add_up, schema)


def _listed_entries(blocks: pa.Table, asked: pa.Array, dim: int, names: list[str]) -> pa.Table:
    """What the terms of all ``blocks`` of a shard add to each document of ``asked``, by place."""
    docs = flat(blocks["docs"])
    lengths = pc.list_value_length(blocks["docs"]).to_numpy(zero_copy_only=False).astype(np.int64)
    tfs = flat(blocks["tfs"]).to_numpy(zero_copy_only=False).astype(np.int64)
    # Terms by their text, so that equal documents get equal sums wherever they lie.
    terms = blocks["term"].combine_chunks().dictionary_encode()
    order = pc.sort_indices(terms.dictionary).to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    block_term = number[terms.indices.to_numpy()]
    idf, bucket = np.zeros(len(order)), np.zeros(len(order), np.int64)
    idf[block_term], bucket[block_term] = blocks["idf"].to_numpy(), blocks["bucket"].to_numpy()
    ids = docs.dictionary_encode()
    n_docs = max(1, len(ids.dictionary))
    key = np.repeat(block_term, lengths) * n_docs + ids.indices.to_numpy()
    # A document may have a term in several fields.
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    tf = np.add.reduceat(tfs[order], first) if len(first) else np.zeros(0, np.int64)
    term, doc = np.divmod(key[first], n_docs)
    value = (1.0 + np.log(tf.astype(np.float64))) * idf[term]
    cell = doc * dim + bucket[term]
    if n_docs * dim <= _CELLS_PER_POSTING * len(cell):
        totals = np.bincount(cell, value, minlength=n_docs * dim)
        entry = np.flatnonzero(totals)
        sums = totals[entry]
    else:
        entry, at = np.unique(cell, return_inverse=True)
        sums = np.bincount(at, value, minlength=len(entry))
    owner, place = np.divmod(entry, dim)
    bounds = np.searchsorted(owner, np.arange(len(ids.dictionary) + 1)).astype(np.int32)
    lists = [
        pa.ListArray.from_arrays(pa.array(bounds), pa.array(place.astype(np.int32))),
        pa.ListArray.from_arrays(pa.array(bounds), pa.array(sums)),
    ]
    where = pc.index_in(asked, value_set=ids.dictionary)
    return pa.table([asked, *(column.take(where) for column in lists)], names=names)


def hash_queries(index: TextIndex, queries: DataFrame, config: DenseConfig = DenseConfig()) -> DataFrame:
    """Query vectors in the same space: term weights come from the corpus."""
    small = query_bytes(queries) <= config.broadcast_bytes
    return hashed_vectors(query_terms(queries), content_idf(index), queries, config, "qid", "qtf", small)
