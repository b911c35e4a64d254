"""Lexical index and BM25 search over several weighted text fields.

Index rows stay together by document. Scoring a batch of queries then needs no shuffle of
postings or of scored pairs: query terms travel to the postings, in slices of bounded size, sums and
the best field are formed where the document lies, and only k rows per query and partition are
exchanged. Within a bucket, postings are in order of their term, so a query of few words reads only
the pages that may hold them.

A written index also holds its postings as blocks with upper bounds, and a search then leaves out what
cannot be among the first k; see :mod:`rankloom.operators.postings_blocks`.

Searching starts jobs while the plan is built: the query words are measured, with blocks the weights are
fetched and the floors found, and with more than one slice the passes over the postings run.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from rankloom.config import Bm25Config
from rankloom.functions.guards import positive_k
from rankloom.functions.scores import inverse_document_frequency, saturation
from rankloom.functions.text import words
from rankloom.operators import postings_blocks
from rankloom.operators.postings_blocks import BlockSet
from rankloom.operators.ranking import top_k
from rankloom.schemas import run_schema
from rankloom.session import materialise


# Words that Spark hands to the reader as they are (spark.sql.parquet.pushdown.inFilterThreshold); of
# more it would only use the first and the last.
_PUSHED_TERMS = 10
# What a row of query terms takes besides its texts.
_ROW_BYTES = 160
# Text whose words one task counts; the tables it counts in take some twenty times as much.
_PLANNED_BYTES = 8 << 20
# Postings that a counter hands over at a time.
_BATCH_ROWS = 1 << 16
# A query has words for at least so many rows of results.
_ROWS_PER_WORDS = 64


@dataclass(frozen=True)
class TextIndex:
    """Tables of a lexical index.

    ``postings(doc_id, field, term, tf, dl)``, ``doc_len(doc_id, field, dl)``,
    ``field_stats(field, n_docs, avgdl)``, ``term_stats(field, term, df)`` and, over all fields of
    a document together, ``content_stats(term, df)``. ``names`` are the fields that were indexed,
    ``buckets`` the number of buckets by document of a written index, and ``blocks`` its postings in blocks.
    """

    postings: DataFrame
    doc_len: DataFrame
    field_stats: DataFrame
    term_stats: DataFrame
    content_stats: DataFrame
    names: tuple[str, ...] = ("title", "text")
    buckets: int | None = None
    blocks: tuple[BlockSet, ...] = ()

    @cached_property
    def n_docs(self) -> int:
        """Documents with at least one word, counted once."""
        return self.doc_len.agg(F.count_distinct("doc_id")).first()[0]

    @cached_property
    def fields(self) -> dict[str, Row]:
        """Statistics by field, read once: one row per field."""
        return {row.field: row for row in self.field_stats.collect()}


def field_words(corpus: DataFrame, fields: Sequence[str] = ("title", "text")) -> DataFrame:
    """One row per document and field: its words in order and their number ``dl``.

    The words are formed inside the generator, so that a filter on them cannot be pushed below it
    and run the pattern over the text a second time.
    """
    parts = F.array(*[F.struct(F.lit(name).alias("field"), words(F.col(name)).alias("words")) for name in fields])
    return corpus.select("doc_id", F.inline(parts)).withColumn("dl", F.size("words"))


def tokenize(corpus: DataFrame, fields: Sequence[str] = ("title", "text")) -> DataFrame:
    """One row per word occurrence: document, field, position from 0, term."""
    return field_words(corpus, fields).select("doc_id", "field", F.posexplode("words").alias("pos", "term"))


def term_frequency(corpus: DataFrame, fields: Sequence[str] = ("title", "text")) -> DataFrame:
    """Postings. The field length rides along as ``dl``, so scoring needs no join for it."""
    return (
        field_words(corpus, fields)
        .select("doc_id", "field", "dl", F.explode("words").alias("term"))
        .groupBy("doc_id", "field", "dl", "term")
        .agg(F.count(F.lit(1)).cast("int").alias("tf"))
        .select("doc_id", "field", "term", "tf", "dl")
    )


def counted_postings(corpus: DataFrame, fields: Sequence[str] = ("title", "text")) -> DataFrame:
    """The rows of :func:`term_frequency` for a corpus in which no ``doc_id`` repeats, counted where the documents lie.

    The words of a batch of documents go to a counter in one piece, and its postings come back in order of term
    and document, which leaves little to a sort of theirs.
    """
    key = corpus.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", key),
            T.StructField("field", T.StringType()),
            T.StructField("term", T.StringType()),
            T.StructField("tf", T.IntegerType()),
            T.StructField("dl", T.IntegerType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = postings_blocks.counted(batch.filter(pc.greater(batch.column("dl"), 0)))
            for start in range(0, counted.num_rows, _BATCH_ROWS):
                yield counted.slice(start, _BATCH_ROWS)

    return field_words(corpus, fields).select("doc_id", "field", "words", "dl").mapInArrow(run, schema)


def doc_lengths(corpus: DataFrame, fields: Sequence[str] = ("title", "text")) -> DataFrame:
    """Length of every field that has at least one word."""
    return field_words(corpus, fields).select("doc_id", "field", "dl").where(F.col("dl") > 0)


def field_statistics(doc_len: DataFrame) -> DataFrame:
    """Documents that have the field, and their mean length."""
    return doc_len.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_docs"),
        (F.sum(F.col("dl").cast("bigint")) / F.count(F.lit(1))).alias("avgdl"),
    )


def term_statistics(postings: DataFrame) -> DataFrame:
    """Document frequency per field and term, over all documents."""
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def content_frequency(postings: DataFrame) -> DataFrame:
    """Term frequency over all fields of a document. No shuffle where postings lie by document."""
    return postings.groupBy("doc_id", "term").agg(F.sum("tf").cast("int").alias("tf"))


def content_statistics(postings: DataFrame) -> DataFrame:
    """Document frequency per term, in whichever field it stands."""
    return content_frequency(postings).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_idf(term_stats: DataFrame, field_stats: DataFrame) -> DataFrame:
    """``field_stats`` has one row per field, so it is small by construction."""
    return term_stats.join(F.broadcast(field_stats.select("field", "n_docs")), "field").select(
        "field", "term", "df", inverse_document_frequency(F.col("n_docs"), F.col("df")).alias("idf")
    )


def index_corpus(corpus: DataFrame, fields: Sequence[str] = ("title", "text"), partitions: int | None = None) -> TextIndex:
    """Plan an index. Documents are placed by ``doc_id`` first, so postings need no second shuffle.

    Without ``partitions`` there are as many as the measured text asks for, so that the words a task counts
    stay within bounds however large the corpus is.
    """
    texts = corpus.select("doc_id", *fields)
    placed = texts.repartition(partitions or _planned_partitions(texts, fields), "doc_id")
    postings = term_frequency(placed, fields)
    doc_len = doc_lengths(texts, fields)
    return TextIndex(
        postings,
        doc_len,
        field_statistics(doc_len),
        term_statistics(postings),
        content_statistics(postings),
        tuple(fields),
    )


def _planned_partitions(texts: DataFrame, fields: Sequence[str]) -> int:
    size = sum((F.coalesce(F.octet_length(name), F.lit(0)).cast("bigint") for name in fields), F.lit(0).cast("bigint"))
    total = texts.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // _PLANNED_BYTES))


def indexed_lengths(postings: DataFrame) -> DataFrame:
    """Field lengths as the postings carry them. No shuffle where postings lie by document."""
    return postings.select("doc_id", "field", "dl").distinct()


def query_terms(queries: DataFrame) -> DataFrame:
    """Terms of each query with their multiplicity: a repeated word counts each time."""
    return (
        queries.select("qid", F.explode(words(F.col("text"))).alias("term"))
        .groupBy("qid", "term")
        .agg(F.count(F.lit(1)).cast("int").alias("qtf"))
    )


def score(index: TextIndex, queries: DataFrame, config: Bm25Config = Bm25Config(), push: bool = True) -> DataFrame:
    """Score every (query, document) pair that shares a term: the best field counts, not the sum.

    ``queries`` are one slice: their words are broadcast. :func:`bm25_top_k` makes the slices. With
    ``push``, their words are counted first, and a few are handed to the reader of the postings.
    """
    terms = query_terms(queries)
    idf = _boosted_idf(index, config)
    # No filter by field: only the wanted fields have weights to be joined with.
    postings = index.postings.select("doc_id", "field", "term", "tf", "dl")
    few = terms.select("term").distinct().limit(_PUSHED_TERMS + 1).collect() if push else []
    if push and len(few) <= _PUSHED_TERMS:
        wanted = F.col("term").isin([row.term for row in few])
        postings, idf = postings.where(wanted), idf.where(wanted)
    weighted = F.broadcast(_weights(idf.join(F.broadcast(terms), "term")))
    matched = postings.join(weighted, ["field", "term"])

    part = F.col("weight") * saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), config.k1, config.b)
    by_field = [
        F.sum(F.when(F.col("place") == place, part)).alias(f"__{name}")
        for place, name in enumerate(config.fields)
    ]
    sums = matched.groupBy("doc_id", "qid").agg(*by_field)
    columns = [F.col(f"__{name}") for name in config.fields]
    best = F.greatest(*columns) if len(columns) > 1 else columns[0]
    return sums.select("qid", "doc_id", best.alias("score"))


def _boosted_idf(index: TextIndex, config: Bm25Config) -> DataFrame:
    """What a query word is worth per field and term, with all that scoring needs to know of the
    field: its place in the settings and its mean length.

    These are one number per field, so they go into the plan as literals. They are attached here,
    on the small side, since text compared once per posting match is what scoring would spend
    most of its time on.
    """
    boosts, stats = dict(config.boosts), index.fields
    missing = sorted(set(boosts) - set(index.names))
    if missing:
        raise ValueError(f"the index has no field {', '.join(missing)}; its fields are {', '.join(index.names)}")
    known = {name: place for place, name in enumerate(config.fields) if name in stats}

    n_docs = _chosen({name: int(stats[name].n_docs) for name in known})
    idf = inverse_document_frequency(n_docs, F.col("df"))
    return index.term_stats.where(F.col("field").isin(*known)).select(
        "field",
        "term",
        _chosen(known).cast("int").alias("place"),
        _chosen({name: float(stats[name].avgdl) for name in known}).alias("avgdl"),
        (_chosen({name: float(boosts[name]) for name in known}) * idf).alias("idf"),
    )


def _chosen(values: Mapping[str, int | float]) -> Column:
    """The number that belongs to the field of the row."""
    column = F.lit(None).cast("double")
    for name, value in values.items():
        column = F.when(F.col("field") == name, F.lit(value)).otherwise(column)
    return column


def query_bytes(queries: DataFrame, fields: int = 1) -> int:
    """Upper bound for the size of the query terms, from one pass without a shuffle of terms.

    Every word may be a row of its own for every field: the word, the query's id, the name of the field
    and the numbers of the row, with what a hash table adds to them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.octet_length(F.col("qid").cast("string")), F.lit(0))
    charge = F.octet_length(text) + F.size(words(text)) * (key + F.lit(_ROW_BYTES))
    return fields * queries.agg(F.coalesce(F.sum(charge.cast("bigint")), F.lit(0))).first()[0]


def _weights(idf_by_query: DataFrame) -> DataFrame:
    weight = F.col("qtf") * F.col("idf")
    return idf_by_query.select("qid", "field", "term", "place", "avgdl", weight.alias("weight"))


def bm25_top_k(index: TextIndex, queries: DataFrame, k: int, config: Bm25Config = Bm25Config()) -> DataFrame:
    """Ranked run. Only matching documents come back, so a query may have fewer than ``k`` rows.

    Queries whose words take more than ``config.broadcast_bytes`` are answered slice by slice, one pass
    over the postings each; postings are never moved.
    """
    positive_k(k)
    size = query_bytes(queries, len(config.fields))
    # No need to count the words of queries that are clearly more than the reader takes.
    push = size <= 8 * _PUSHED_TERMS * _ROW_BYTES * len(config.fields)

    def answer(asked: DataFrame, few: bool) -> DataFrame:
        if index.blocks:
            return search_blocks(index, asked, k, config)[0]
        return top_k(score(index, asked, config, few), k)

    done = None
    slices = _slices(queries, size, k, config)
    if len(slices) == 1:
        return answer(queries, push)
    for asked in slices:
        run = materialise(answer(asked, False), "bm25-slice")
        done = run if done is None else done.unionByName(run)
    return done


def _slices(queries: DataFrame, size: int, k: int, config: Bm25Config) -> list[DataFrame]:
    """The queries in parts whose words take at most about ``config.broadcast_bytes``, all of them ``size``.

    A query's words are at least as large as a row of the first pass, so ``k`` rows for each are counted on top.
    """
    count = max(1, -(-size * max(1, k // _ROWS_PER_WORDS) // max(1, config.broadcast_bytes)))
    part = F.pmod(F.xxhash64("qid"), F.lit(count))
    return [queries.where(part == number) for number in range(count)] if count > 1 else [queries]


def search_blocks(index: TextIndex, queries: DataFrame, k: int, config: Bm25Config = Bm25Config()) -> tuple[DataFrame, DataFrame]:
    """The run of one slice of queries over the blocks of a written index, and what each query cost."""
    weighted = _weights(_boosted_idf(index, config).join(F.broadcast(query_terms(queries)), "term"))
    return postings_blocks.search(
        list(index.blocks), weighted, k, config, queries.schema["qid"].dataType, index.postings.schema["doc_id"].dataType
    )


def bm25_places(index: TextIndex, queries: DataFrame, pairs: DataFrame, config: Bm25Config = Bm25Config()) -> DataFrame:
    """``(qid, doc_id, rank)``: the places that ``pairs(qid, doc_id)`` have in the whole lists of ``queries``.

    Works on the blocks of a written index, slice by slice as a search does.
    """
    types = (queries.schema["qid"].dataType, index.postings.schema["doc_id"].dataType)
    schema = T.StructType([*run_schema(*types).fields[:2], T.StructField("rank", T.IntegerType())])
    most = pairs.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if not most:
        return queries.sparkSession.createDataFrame([], schema)
    done = None
    for asked in _slices(queries, query_bytes(queries, len(config.fields)), most, config):
        weighted = _weights(_boosted_idf(index, config).join(F.broadcast(query_terms(asked)), "term"))
        own = pairs.join(F.broadcast(asked.select("qid")), "qid", "left_semi")
        placed = materialise(postings_blocks.places(list(index.blocks), weighted, own, config, schema), "bm25-places")
        done = placed if done is None else done.unionByName(placed)
    return done


def query_cost(index: TextIndex, queries: DataFrame, k: int, config: Bm25Config = Bm25Config()) -> DataFrame:
    """``(qid, postings, documents)``: postings that a search meets for each query with a known word, and
    documents that it scores in full.

    These are counted in the scoring pass itself, over the blocks of a written index. With ``config.prune``
    off these are all matches.
    """
    positive_k(k)
    done = None
    for asked in _slices(queries, query_bytes(queries, len(config.fields)), k, config):
        cost = materialise(search_blocks(index, asked, k, config)[1], "query-cost")
        done = cost if done is None else done.unionByName(cost)
    return done.select("qid", F.col("met").alias("postings"), F.col("scored").alias("documents"))
