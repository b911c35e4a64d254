"""The retrieval data model over the given test tables.

Documents are ``documents`` with the first line as title and the rest as text, queries are the
passages of ``benchmark``, and a document is relevant to a passage if it holds the passage word
for word. A passage without words is relevant to nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.config import DenseConfig, HybridConfig
from rankloom.functions.text import words
from rankloom.operators.dense import dense_top_k
from rankloom.operators.encoding import hash_documents, hash_queries
from rankloom.operators.joins import broadcast_within, heavy_keys, salted_join
from rankloom.operators.lexical import TextIndex, bm25_top_k
from rankloom.operators.retrievers import Bm25Retriever, DenseRetriever
from rankloom.session import materialise, scratch_path
from rankloom.sources.indexes import load_vectors, write_text_index, write_vectors

DENSE = DenseConfig(dim=256)
K = 10
# Fusion reads both sides to this depth.
RUN_DEPTH = HybridConfig().fetch_depth(K)
# Words of the phrase that leads from a document to the passages it may hold; shorter passages lead
# by all their words.
_ANCHOR_WORDS = 3
_ANCHOR_BYTES = 64 << 20

_built: dict[tuple[str, str, str], Any] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], Any]) -> Any:
    """Built once per application and data folder; the tables lie in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, title, text)``; a document of one line has an empty text."""
    text = F.col("text")
    newline = F.instr(text, "\n")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.substring_index(text, "\n", 1).alias("title"),
        F.when(newline > 0, F.substr(text, newline + 1)).otherwise("").alias("text"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "qrels", lambda: materialise(derive_qrels(spark, sf_dir), "qrels"))


def derive_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(qid, doc_id)`` where the words of the passage occur in a row in the document.

    The longest three-word phrase of a passage, or all of a shorter one, leads to the documents that
    may hold it, and only those are compared in full.
    """
    by_length = [
        queries(spark, sf_dir)
        .select("qid", words(F.col("text")).alias("words"))
        .where(F.size("words") >= size if size == _ANCHOR_WORDS else F.size("words") == size)
        .select("qid", F.concat_ws(" ", "words").alias("passage"), _phrases(F.col("words"), size).alias("phrases"))
        for size in range(1, _ANCHOR_WORDS + 1)
    ]
    passages = reduce(DataFrame.unionByName, by_length)
    # Equal passages are looked up once, however many copies there are.
    longest = F.array_max(F.transform("phrases", lambda p: F.struct(F.length(p).alias("n"), p.alias("phrase"))))
    anchors = passages.select("passage", longest["phrase"].alias("phrase")).distinct()

    found = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("words"))
    # Phrases are only looked for in the lengths that lead to a passage: at most three numbers.
    sizes = anchors.withColumn("n", F.size(F.split("phrase", " ")))
    lengths = [r.n for r in sizes.select("n").distinct().collect()] or [_ANCHOR_WORDS]
    # A word with those after it, as columns: phrases are never put together as text.
    follow = [F.col("words"), *[F.expr(f"slice(words, {n + 1}, greatest(size(words) - {n}, 0))") for n in range(1, max(lengths))]]
    places = found.select("doc_id", F.inline(F.arrays_zip(*[c.alias(f"w{n}") for n, c in enumerate(follow)]))).toDF(
        "doc_id", *[f"w{n}" for n in range(max(lengths))]
    )
    parts = []
    for size in lengths:
        names = [f"w{n}" for n in range(size)]
        split = F.split("phrase", " ")
        leads = sizes.where(F.col("n") == size).select("passage", *[split[n].alias(name) for n, name in enumerate(names)])
        small = broadcast_within(leads, _ANCHOR_BYTES, "passage", *names)
        if small is not None:
            parts.append(places.join(small, names))
        else:
            counts = places.where(F.col(names[-1]).isNotNull()).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
            heavy = heavy_keys(counts, names, "n")
            parts.append(salted_join(places.where(F.col(names[-1]).isNotNull()), leads, names, heavy, F.col("doc_id")))
    candidates = reduce(DataFrame.unionByName, [part.select("doc_id", "passage") for part in parts]).distinct()
    candidates = materialise(candidates, "qrels-candidates")
    # Few documents are compared in full, and then only their words are formed again.
    near = broadcast_within(candidates, _ANCHOR_BYTES, "passage")
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    if near is not None:
        compared = texts.join(near, "doc_id")
    else:
        compared = texts.join(candidates, "doc_id")
    padded = F.concat_ws(" ", F.lit(""), F.concat_ws(" ", words(F.col("text"))), F.lit(""))
    held = compared.where(F.contains(padded, F.concat(F.lit(" "), F.col("passage"), F.lit(" "))))
    return held.select("doc_id", "passage").join(passages.select("qid", "passage"), "passage").select("qid", "doc_id")


def _phrases(words_column, size: int):
    """All runs of ``size`` consecutive words; none for shorter texts."""
    last = F.size(words_column) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words_column, i + step) for step in range(size)]))


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    return _once(
        spark,
        sf_dir,
        "text-index",
        lambda: write_text_index(spark, corpus(spark, sf_dir), scratch_path(spark, "text-index")),
    )


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        path = scratch_path(spark, "vectors")
        index = text_index(spark, sf_dir)
        write_vectors(hash_documents(index, corpus(spark, sf_dir), DENSE), path)
        return load_vectors(spark, path)

    return _once(spark, sf_dir, "vectors", build)


def encode_queries(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return hash_queries(text_index(spark, sf_dir), rows, DENSE)


def retrievers(spark: SparkSession, sf_dir: str) -> dict[str, Any]:
    return {
        "bm25": Bm25Retriever(text_index(spark, sf_dir)),
        "dense": DenseRetriever(
            document_vectors(spark, sf_dir), lambda rows: encode_queries(spark, sf_dir, rows), DENSE
        ),
    }


def runs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Both sides for all queries, deep enough for fusion."""

    def build() -> dict[str, DataFrame]:
        asked = queries(spark, sf_dir)
        return {
            "bm25": materialise(bm25_top_k(text_index(spark, sf_dir), asked, RUN_DEPTH), "run-bm25"),
            "dense": materialise(
                dense_top_k(encode_queries(spark, sf_dir, asked), document_vectors(spark, sf_dir), RUN_DEPTH, DENSE),
                "run-dense",
            ),
        }

    return _once(spark, sf_dir, "runs", build)


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(method, qid, seconds)``: the event log as a timing table, one method per type of event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("method"), F.col("event_id").alias("qid"), F.col("value").alias("seconds")
    )
