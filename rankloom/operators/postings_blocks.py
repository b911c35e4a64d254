"""Search over blocks of postings with upper bounds.

A block holds up to ``BLOCK`` postings of one term and field in one shard of the documents, as arrays, with
the largest frequency and the least field length among them: together these bound what the block can add to
any score. All blocks of a shard lie in one bucket, so a task has all that its documents can score.

Where there are more shards than tasks can run at once, a first pass over a few of them gives every query a
floor: its k-th best score there. In the other shards a query's terms are gone through from the largest bound to the least. While the terms still to come could
lift a document above the floor by themselves, every posting counts; after that, only documents that can
still pass the floor are looked up, and they get fewer with every term. What is left out cannot be among the
first k, so the run is the same as that of scoring every document.

Weights of one slice of queries, measured before, go to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rankloom.config import Bm25Config
from rankloom.operators.places import Asked, plain_ids
from rankloom.operators.ranking import top_k

BLOCK = 128
# Blocks that are handed over at a time.
_BATCH_BLOCKS = 1 << 14
# Shards of the first pass: one part in FIRST_PART of all, no more than MAX_FIRST, and no more than let their
# rows, of about ROW_BYTES each, stay within the bytes that go to the driver.
FIRST_PART = 8
MAX_FIRST = 64
ROW_BYTES = 48
# Terms that Spark hands to the reader as they are (spark.sql.parquet.pushdown.inFilterThreshold); of more it
# would only use the first and the last.
PUSHED_TERMS = 10
# Floors are compared with bounds a little below them, as scores are ranked in single precision.
_SLACK = 1e-6
# A lookup among the postings of a term costs about as much as adding this many postings.
_LOOKUP = 4


@dataclass(frozen=True)
class BlockSet:
    """Blocks of one written index or segment: ``blocks(shard, field, term, docs, tfs, dls, max_tf, min_dl)``
    with the ``shards`` there are, and the documents that no longer count: ``gone(shard, doc_id)``."""

    blocks: DataFrame
    shards: tuple[int, ...]
    gone: DataFrame | None = None


_shard_numbers: dict[int, list[int]] = {}


def shard_numbers(spark: SparkSession, buckets: int) -> list[int]:
    """For every bucket by document an integer that Spark puts in the bucket of that number."""
    if buckets in _shard_numbers:
        return _shard_numbers[buckets]
    found: dict[int, int] = {}
    reach = 16 * buckets + 64
    while len(found) < buckets:
        numbers = spark.range(reach).select(F.col("id").cast("int").alias("number"))
        rows = numbers.groupBy(bucket_of("number", buckets).alias("bucket")).agg(F.min("number").alias("number"))
        found = {r["bucket"]: r["number"] for r in rows.collect()}
        reach *= 2
    return _shard_numbers.setdefault(buckets, [found[bucket] for bucket in range(buckets)])


def bucket_of(column: str, buckets: int):
    """The bucket that Spark's writer gives a row."""
    return F.pmod(F.hash(column), F.lit(buckets))


def with_shard(rows: DataFrame, numbers: list[int]) -> DataFrame:
    """``rows`` by document with their shard."""
    return rows.withColumn("shard", F.get(F.lit(numbers), bucket_of("doc_id", len(numbers))).cast("int"))


def pack(rows: DataFrame) -> DataFrame:
    """Blocks of postings ``rows(shard, doc_id, field, term, tf, dl)``, made where the rows lie and in their order:
    those of a term and field fill blocks as long as they come one after the other, fields aside.

    Where the rows are documents, with a column of words for every field, the words are counted first, a batch
    of documents at a time.

    ``again`` counts the postings of a block whose document has the term in the row before them, that is in
    another field, where rows are in order of term and document.
    """
    key = rows.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("field", T.StringType()),
            T.StructField("term", T.StringType()),
            T.StructField("docs", T.ArrayType(key)),
            T.StructField("tfs", T.ArrayType(T.IntegerType())),
            T.StructField("dls", T.ArrayType(T.IntegerType())),
            T.StructField("max_tf", T.IntegerType()),
            T.StructField("min_dl", T.IntegerType()),
            T.StructField("again", T.IntegerType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if batch.num_rows:
                yield _packed(batch, schema.names, last)
                last = batch.slice(batch.num_rows - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            postings = _posted(batch, fields)
            packed = _packed(postings, schema.names) if postings.num_rows else None
            for start in range(0, packed.num_rows if packed else 0, _BATCH_BLOCKS):
                yield packed.slice(start, _BATCH_BLOCKS)

    if "tf" in rows.columns:
        return rows.select("shard", "field", "term", "doc_id", "tf", "dl").mapInArrow(run, schema)
    fields = [name for name in rows.columns if name not in ("shard", "doc_id")]
    return rows.mapInArrow(count, schema)


def unpack(blocks: DataFrame) -> DataFrame:
    """The postings of ``blocks``, where these lie."""
    # A table is only read bucket by bucket if the column of its buckets is read.
    each = blocks.where(F.col("shard").isNotNull()).select("field", "term", F.inline(F.arrays_zip("docs", "tfs", "dls")))
    return each.select(F.col("docs").alias("doc_id"), "field", "term", F.col("tfs").alias("tf"), F.col("dls").alias("dl"))


def _posted(batch: pa.RecordBatch, fields: list[str]) -> pa.RecordBatch:
    """Postings of documents with the words of every field, in order of term and document."""
    words = pa.concat_arrays([batch.column(name) for name in fields])
    lengths = pc.list_value_length(words)
    ids = batch.column("doc_id")
    rows = [pa.concat_arrays([ids] * len(fields)), pa.array(np.repeat(fields, len(ids))), words, lengths]
    found = counted(pa.RecordBatch.from_arrays(rows, names=["doc_id", "field", "words", "dl"]).filter(pc.greater(lengths, 0)))
    shards = batch.column("shard").take(pc.index_in(found.column("doc_id"), value_set=ids))
    return pa.RecordBatch.from_arrays([shards, *found.columns], names=["shard", *found.schema.names])


def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Postings of ``(doc_id, field, words, dl)``, all with words."""
    batch = batch.take(pc.sort_indices(batch.column("doc_id")))
    lengths = batch.column("words").value_lengths().to_numpy(zero_copy_only=False)
    coded = batch.column("words").flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    rows = max(1, batch.num_rows)
    found = number[coded.indices.to_numpy()] * rows + np.repeat(np.arange(batch.num_rows), lengths)
    found.sort()
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(found)), bool), found[1:] != found[:-1])))
    tf = np.diff(np.append(first, len(found))).astype(np.int32)
    term, row = np.divmod(found[first], rows)
    row = pa.array(row)
    columns = [batch.column("doc_id").take(row), batch.column("field").take(row), coded.dictionary.take(pa.array(order[term]))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(tf), batch.column("dl").take(row)], names=["doc_id", "field", "term", "tf", "dl"])


def _repeated(batch: pa.RecordBatch, last: pa.RecordBatch | None) -> np.ndarray:
    """Rows of the shard, term and document of the row before, the first of which is ``last``."""
    found = np.ones(batch.num_rows, bool)
    found[0] = last is not None
    for name in ("shard", "term", "doc_id"):
        column = batch.column(name)
        found[1:] &= pc.equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        if last is not None:
            found[0] &= column[0] == last.column(name)[0]
    return found


def _packed(batch: pa.RecordBatch, names: list[str], last: pa.RecordBatch | None = None) -> pa.RecordBatch:
    again = _repeated(batch, last)
    # Fields are set apart; within each, rows keep their order.
    order = np.argsort(batch.column("field").dictionary_encode().indices.to_numpy(), kind="stable")
    batch, again = batch.take(pa.array(order)), again[order]
    fresh = np.zeros(batch.num_rows, bool)
    fresh[0] = True
    for name in ("shard", "field", "term"):
        column = batch.column(name)
        fresh[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    run_starts = np.flatnonzero(fresh)
    within = np.arange(batch.num_rows) - np.repeat(run_starts, np.diff(np.append(run_starts, batch.num_rows)))
    starts = np.flatnonzero(within % BLOCK == 0)
    offsets = pa.array(np.append(starts, batch.num_rows).astype(np.int32))
    first = pa.array(starts)
    tf, dl = (batch.column(c).to_numpy() for c in ("tf", "dl"))
    columns = [batch.column(c).take(first) for c in ("shard", "field", "term")]
    columns += [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("doc_id", "tf", "dl")]
    columns += [pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(dl, starts))]
    columns.append(pa.array(np.add.reduceat(again, starts, dtype=np.int32)))
    return pa.RecordBatch.from_arrays(columns, names=names)


def statistics(blocks: DataFrame, partitions: int) -> DataFrame:
    """``(field, term, df, again)``: of the blocks that :func:`pack` made of postings in order of term and document,
    documents by field and term, and how many of them another field has already."""
    counts = blocks.select("field", "term", F.size("tfs").alias("n"), "again").repartition(partitions, "term")
    return counts.groupBy("field", "term").agg(F.sum("n").alias("df"), F.sum("again").alias("again"))


def whole_statistics(terms: DataFrame, partitions: int) -> DataFrame:
    """``(term, df)`` over all fields of a document together, from what :func:`statistics` found."""
    counts = terms.select("term", "df", "again").repartition(partitions, "term")
    return counts.groupBy("term").agg((F.sum("df") - F.sum("again")).alias("df"))


@dataclass(frozen=True)
class Weights:
    """What the words of a slice of queries are worth: parallel arrays, in the order of query and field.

    ``places`` and ``lengths`` are the field of every numbered term and its mean length.
    """

    qids: pa.Array
    query: np.ndarray
    place: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    places: np.ndarray
    lengths: np.ndarray

    def parts(self) -> Iterator[tuple[int, slice]]:
        """Each query in each field, as a range of the arrays."""
        if len(self.query):
            fresh = (np.diff(self.query) != 0) | (np.diff(self.place) != 0)
            bounds = np.concatenate(([0], np.flatnonzero(fresh) + 1, [len(self.query)]))
            for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
                yield int(self.query[start]), slice(start, stop)


def gather_weights(weighted: DataFrame) -> tuple[Weights, pa.Table]:
    """Weights of ``weighted(qid, field, term, place, avgdl, weight)``, and their numbered terms."""
    table = weighted.toArrow()
    qids = table["qid"].combine_chunks().dictionary_encode(null_encoding="encode")
    query = qids.indices.to_numpy()
    names = pa.table({"field": table["field"], "term": table["term"]})
    numbered = names.group_by(["field", "term"], use_threads=False).aggregate([])
    numbered = numbered.append_column("number", pa.array(np.arange(numbered.num_rows, dtype=np.int32)))
    where = {key: n for n, key in enumerate(zip(*(numbered[c].to_pylist() for c in ("field", "term")), strict=True))}
    term = np.array([where[key] for key in zip(*(names[c].to_pylist() for c in ("field", "term")), strict=True)], np.int64)
    place, lengths = table["place"].to_numpy(), table["avgdl"].to_numpy()
    places, means = np.zeros(numbered.num_rows, np.int64), np.ones(numbered.num_rows)
    places[term], means[term] = place, lengths
    order = np.lexsort((term, place, query))
    found = Weights(
        qids.dictionary, query[order], place[order], term[order], table["weight"].to_numpy()[order], places, means
    )
    return found, numbered


class Shard:
    """The matched postings of one shard, by term, with the share each adds of its term's weight."""

    def __init__(self, rows: pa.Table, weights: Weights, k1: float, b: float, gone: pa.Table | None = None):
        rows = rows.take(pa.array(np.argsort(rows["number"].to_numpy(), kind="stable")))
        docs = flat(rows["docs"])
        counts = pc.list_value_length(rows["docs"]).to_numpy(zero_copy_only=False).astype(np.int64)
        term = np.repeat(rows["number"].to_numpy(), counts)
        tf, dl = (flat(rows[c]).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("tfs", "dls"))
        if gone is not None and gone.num_rows:
            kept = pc.invert(pc.is_in(docs, value_set=gone["doc_id"].combine_chunks()))
            mask = kept.to_numpy(zero_copy_only=False)
            docs, term, tf, dl = docs.filter(kept), term[mask], tf[mask], dl[mask]
        # Documents by number, in the order of their ids.
        coded = docs.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        self.ids = coded.dictionary.take(pa.array(order))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.doc = number[coded.indices.to_numpy()] if len(docs) else np.zeros(0, np.int64)
        self.share = tf / (tf + k1 * ((1.0 - b) + b * dl / weights.lengths[term]))
        self.starts = np.searchsorted(term, np.arange(len(weights.places) + 1))
        used = np.flatnonzero(np.diff(self.starts))
        self.most = np.zeros(len(weights.places))
        if len(used):
            self.most[used] = np.maximum.reduceat(self.share, self.starts[used])

    def postings(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of some terms, and what they get from each."""
        parts = [slice(self.starts[t], self.starts[t + 1]) for t in terms]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0)
        return (
            np.concatenate([self.doc[p] for p in parts]),
            np.concatenate([w * self.share[p] for w, p in zip(weights, parts, strict=True)]),
        )

    def best(self, terms: np.ndarray, weights: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may reach the floor with their whole scores, and the number of postings met.

        Without a floor (-inf), or with a weight that is not above 0, these are all that match.
        """
        bound = weights * self.most[terms]
        there = self.starts[terms + 1] > self.starts[terms]
        terms, weights, bound = terms[there], weights[there], bound[there]
        order = np.argsort(-bound, kind="stable")
        terms, weights, bound = terms[order], weights[order], bound[order]
        if len(weights) and weights.min() <= 0:
            floor = -np.inf
        # What the terms from a place on can add at most.
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0.0)
        whole = int(np.count_nonzero(rest[:-1] >= floor)) if np.isfinite(floor) else len(terms)
        docs, parts = self.postings(terms[:whole], weights[:whole])
        sums = np.bincount(docs, parts, minlength=len(self.ids))
        seen = np.zeros(len(self.ids), bool)
        seen[docs] = True
        met = len(docs)
        alive = np.flatnonzero(seen & (sums + rest[whole] >= floor))
        for place in range(whole, len(terms)):
            if not len(alive):
                break
            own = slice(self.starts[terms[place]], self.starts[terms[place] + 1])
            listed = self.doc[own]
            if len(alive) * _LOOKUP < len(listed):
                at = np.minimum(np.searchsorted(listed, alive), len(listed) - 1)
                hit = listed[at] == alive
                sums[alive[hit]] += weights[place] * self.share[own][at[hit]]
                met += len(alive)
            else:
                sums[listed] += weights[place] * self.share[own]
                met += len(listed)
            alive = alive[sums[alive] + rest[place + 1] >= floor]
        return alive, sums[alive], met


def flat(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole.flatten() if not isinstance(whole, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in whole.chunks])


def _first_k(docs: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: by single precision, ties by the smaller document."""
    ranked = -scores.astype(np.float32)
    if len(ranked) > 4 * k:
        near = np.flatnonzero(ranked <= np.partition(ranked, k - 1)[k - 1])
        return near[np.lexsort((docs[near], ranked[near]))[:k]]
    return np.lexsort((docs, ranked))[:k]


def scan_shard(shard: Shard, weights: Weights, floors: np.ndarray, k: int) -> pa.Table:
    """query, doc (their numbers) and score of the k best of every query, and postings met and documents
    scored in full per query.

    Counts come in rows of their own, with doc -1.
    """
    queries, docs, scores, postings, scored = [], [], [], {}, {}
    pending: list[tuple[np.ndarray, np.ndarray]] = []
    now = None

    def close() -> None:
        if now is None or not pending:
            return
        doc, score = _best_field(*zip(*pending, strict=True))
        scored[now] = len(doc)
        top = _first_k(doc, score, k)
        queries.append(np.full(len(top), now))
        docs.append(doc[top])
        scores.append(score[top])

    for query, part in weights.parts():
        if query != now:
            close()
            now, pending = query, []
        floor = floors[query] * (1.0 - _SLACK) if np.isfinite(floors[query]) and floors[query] > 0 else -np.inf
        doc, score, met = shard.best(weights.term[part], weights.weight[part], floor)
        pending.append((doc, score))
        postings[query] = postings.get(query, 0) + met
    close()
    asked = np.array(list(postings), np.int64)
    return pa.table(
        {
            "query": np.concatenate([*queries, asked]) if queries else asked,
            "doc": np.concatenate([*docs, np.full(len(asked), -1)]) if docs else np.full(len(asked), -1),
            "score": np.concatenate([*scores, np.zeros(len(asked))]) if scores else np.zeros(len(asked)),
            "met": pa.array([0] * sum(map(len, docs)) + list(postings.values()), pa.int64()),
            "scored": pa.array([0] * sum(map(len, docs)) + [scored.get(q, 0) for q in postings], pa.int64()),
        }
    )


def _scan(
    found: BlockSet, shards: list[int], names: pa.Table, shared, floors, k: int, config: Bm25Config, schema: T.StructType
) -> DataFrame:
    """One task per shard: qid, doc_id, score, met and scored."""
    k1, b = config.k1, config.b
    matched = _matched(found, shards, names)

    def scan(rows: pa.Table, gone: pa.Table | None = None) -> pa.Table:
        weights = shared.value
        shard = Shard(rows, weights, k1, b, gone)
        lows = floors.value if floors else np.full(len(weights.qids), -np.inf)
        result = scan_shard(shard, weights, lows, k)
        doc = result["doc"].to_numpy()
        where = pa.array(doc, mask=doc < 0)
        return pa.table(
            [weights.qids.take(result["query"].combine_chunks()), shard.ids.take(where), *(result[c] for c in ("score", "met", "scored"))],
            names=schema.names,
        )

    return _by_shard(found, matched, scan, schema)


def _matched(found: BlockSet, shards: list[int], names: pa.Table) -> DataFrame:
    """The blocks of the numbered terms in some shards."""
    numbered = found.blocks.sparkSession.createDataFrame(names)
    blocks = found.blocks.where(F.col("shard").isin(shards)) if len(shards) < len(found.shards) else found.blocks
    if names.num_rows <= PUSHED_TERMS:
        # Within a bucket, blocks are in order of their term: pages without these need not be read.
        blocks = blocks.where(F.col("term").isin(sorted(set(names["term"].to_pylist()))))
    return blocks.select("shard", "field", "term", "docs", "tfs", "dls").join(
        F.broadcast(numbered), ["field", "term"]
    ).select("shard", "number", "docs", "tfs", "dls")


def _by_shard(found: BlockSet, matched: DataFrame, scan, schema: T.StructType) -> DataFrame:
    """``scan`` of every shard's matched blocks and of its documents that are gone, if the set has any."""
    if found.gone is None:
        return matched.groupBy("shard").applyInArrow(lambda rows: scan(rows), schema)
    gone = found.gone.select("shard", "doc_id")
    return (
        matched.groupBy("shard")
        .cogroup(gone.groupBy("shard"))
        .applyInArrow(lambda rows, lost: scan(rows, lost) if rows.num_rows else schema_table(schema, rows, lost), schema)
    )


def schema_table(schema: T.StructType, rows: pa.Table, gone: pa.Table) -> pa.Table:
    """No rows: a shard with nothing but documents that are gone."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()


def search(sets: list[BlockSet], weighted: DataFrame, k: int, config: Bm25Config, qid: T.DataType, doc_id: T.DataType) -> tuple[DataFrame, DataFrame]:
    """``(run, cost)``: the ranked run, and ``cost(qid, met, scored)``, postings met and documents scored.

    ``weighted`` is one slice of queries. With ``config.prune`` the first pass runs while the plan is built.
    """
    spark = weighted.sparkSession
    weights, names = gather_weights(weighted)
    schema = T.StructType(
        [
            T.StructField("qid", qid),
            T.StructField("doc_id", doc_id),
            T.StructField("score", T.DoubleType()),
            T.StructField("met", T.LongType()),
            T.StructField("scored", T.LongType()),
        ]
    )
    if not len(weights.qids) or not sets:
        empty = spark.createDataFrame([], schema)
        return top_k(empty.select("qid", "doc_id", "score"), k), empty.select("qid", "met", "scored")
    context = spark.sparkContext
    shared = context.broadcast(weights)
    largest = max(range(len(sets)), key=lambda s: len(sets[s].shards))
    most = config.broadcast_bytes // (ROW_BYTES * len(weights.qids) * (k + 1))
    first = min(MAX_FIRST, -(-len(sets[largest].shards) // FIRST_PART), max(1, most)) if config.prune else 0
    if sum(len(found.shards) for found in sets) <= context.defaultParallelism:
        first = 0  # all shards run at once; a pass before that would only make them wait
    parts, floors = [], None
    if first:
        begun = _scan(sets[largest], list(sets[largest].shards[:first]), names, shared, None, k, config, schema).toArrow()
        parts.append(spark.createDataFrame(begun, schema))
        floors = context.broadcast(_floors(begun, weights.qids, k))
    for place, found in enumerate(sets):
        rest = list(found.shards[first:] if place == largest else found.shards)
        if rest:
            parts.append(_scan(found, rest, names, shared, floors, k, config, schema))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    run = top_k(rows.where(F.col("doc_id").isNotNull()).select("qid", "doc_id", "score"), k)
    cost = rows.groupBy("qid").agg(F.sum("met").alias("met"), F.sum("scored").alias("scored"))
    return run, cost


def _floors(begun: pa.Table, qids: pa.Array, k: int) -> np.ndarray:
    """The k-th best score of every query so far; -inf where there are fewer. One number per query."""
    found = begun.filter(pc.is_valid(begun["doc_id"]))
    floors = np.full(len(qids), -np.inf)
    if found.num_rows:
        query = pc.index_in(found["qid"], value_set=qids).to_numpy()
        score = found["score"].to_numpy().astype(np.float32)
        order = np.lexsort((-score, query))
        query, score = query[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        floors[query[place == k - 1]] = score[place == k - 1]
    return floors


def _whole_lists(shard: Shard, weights: Weights) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every query its documents in the shard, by number, with their scores: the best field counts."""
    now, docs, scores = None, [], []
    for query, part in weights.parts():
        if query != now and now is not None:
            yield now, *_best_field(docs, scores)
            docs, scores = [], []
        now = query
        doc, score, _ = shard.best(weights.term[part], weights.weight[part], -np.inf)
        docs.append(doc)
        scores.append(score)
    if now is not None:
        yield now, *_best_field(docs, scores)


def _best_field(docs: Sequence[np.ndarray], scores: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A query's documents once each: the best field counts."""
    doc, score = np.concatenate(docs), np.concatenate(scores)
    order = np.lexsort((-score, doc))
    doc, score = doc[order], score[order]
    first = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
    return doc[first], score[first]


def places(sets: list[BlockSet], weighted: DataFrame, pairs: DataFrame, config: Bm25Config, schema: T.StructType) -> DataFrame:
    """``(qid, doc_id, rank)``: the places of ``pairs(qid, doc_id)`` in the whole lists of one slice of queries.

    Pairs without a common word are not there. The blocks are gone over twice: for the scores of the pairs, and to
    count what ranks before them.
    """
    spark, context = weighted.sparkSession, weighted.sparkSession.sparkContext
    weights, names = gather_weights(weighted)
    if not len(weights.qids) or not sets:
        return spark.createDataFrame([], schema)
    shared = context.broadcast(weights)
    table = pairs.select("qid", "doc_id").toArrow()
    query = pc.index_in(table["qid"], value_set=weights.qids)
    # Queries without a known word have no list.
    table, query = table.filter(query.is_valid()), query.drop_null().to_numpy()
    wanted = context.broadcast((query, table["doc_id"].combine_chunks()))
    k1, b = config.k1, config.b
    pair_schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("score", T.DoubleType())])

    def score(rows: pa.Table, gone: pa.Table | None = None) -> pa.Table:
        shard = Shard(rows, shared.value, k1, b, gone)
        queries, ids = wanted.value
        at = pc.index_in(ids, value_set=shard.ids).fill_null(-1).to_numpy(zero_copy_only=False)
        here = np.flatnonzero(at >= 0)
        here = here[np.argsort(queries[here], kind="stable")]
        asked = queries[here]
        found, scores = [], []
        for number, doc, value in _whole_lists(shard, shared.value):
            own = here[np.searchsorted(asked, number, "left") : np.searchsorted(asked, number, "right")]
            if len(own) and len(doc):
                place = np.minimum(np.searchsorted(doc, at[own]), len(doc) - 1)
                hit = doc[place] == at[own]
                found.append(own[hit])
                scores.append(value[place[hit]])
        empty = np.zeros(0, np.int64)
        return pa.table(
            [np.concatenate([empty, *found]), np.concatenate([empty.astype(float), *scores])], names=pair_schema.names
        )

    def union(scan, kind: T.StructType) -> DataFrame:
        parts = [_by_shard(found, _matched(found, list(found.shards), names), scan, kind) for found in sets]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows

    scored = union(score, pair_schema).toArrow()
    row = scored["row"].to_numpy()
    if not len(row):
        return spark.createDataFrame([], schema)
    found = table.take(pa.array(row))
    given = context.broadcast((query[row], found["doc_id"].combine_chunks(), scored["score"].to_numpy()))
    count_schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("before", T.LongType())])

    def count(rows: pa.Table, gone: pa.Table | None = None) -> pa.Table:
        weights = shared.value
        shard = Shard(rows, weights, k1, b, gone)
        asked, ids = Asked(*given.value, len(weights.qids)), plain_ids(shard.ids)
        for number, doc, value in _whole_lists(shard, weights):
            asked.add(number, ids[doc], value)
        before = asked.before()
        return pa.table([np.arange(len(before)), before], names=count_schema.names)

    total = union(count, count_schema).groupBy("row").agg(F.sum("before").alias("before"))
    numbered = found.append_column("row", pa.array(np.arange(found.num_rows))).select(["row", "qid", "doc_id"])
    numbered = spark.createDataFrame(numbered, T.StructType([T.StructField("row", T.LongType()), *schema.fields[:2]]))
    return numbered.join(total, "row").select("qid", "doc_id", (F.col("before") + 1).cast("int").alias("rank"))
