"""Second-stage ranking: the documents a run has found are scored again by a function that reads their texts.

Texts lie in a table bucketed by document and are fetched late, for the pairs of the run alone. The pairs, which
are few and narrow, go to the buckets; the texts do not move and are not sorted: each task holds the pairs of its
bucket in a hash table and reads its texts past them. Queries are joined to the pairs, not to the texts. The
scorer gets Arrow batches of pairs and returns one number for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rankloom.functions.guards import positive_k
from rankloom.functions.scores import single_precision
from rankloom.operators.ranking import top_k
from rankloom.schemas import run_schema

# ``scorer(queries, texts)`` gives one number per pair.
PairScorer = Callable[[Sequence[str], Sequence[str]], np.ndarray]

BUCKET_BYTES = 128 << 20
# Pairs scored at a time.
BATCH_PAIRS = 64


@dataclass(frozen=True)
class Texts:
    """``table(doc_id, text)`` in ``buckets`` by document."""

    table: DataFrame
    buckets: int


def write_texts(spark: SparkSession, texts: DataFrame, path: str, buckets: int | None = None) -> Texts:
    """``texts(doc_id, text)`` at ``path``, bucketed by document, replacing what is there."""
    if not buckets:
        size = texts.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")), F.lit(0))).first()[0]
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    key = texts.schema["doc_id"].dataType.simpleString()
    name = _name(path, key, buckets)
    rows = texts.select("doc_id", "text").repartition(buckets, "doc_id")
    rows.write.mode("overwrite").bucketBy(buckets, "doc_id").option("path", path).saveAsTable(name)
    return Texts(spark.table(name), buckets)


def load_texts(spark: SparkSession, path: str, key: str, buckets: int) -> Texts:
    """Open written texts whose ids have type ``key``."""
    name = _name(path, key, buckets)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (doc_id {key}, text STRING) USING parquet OPTIONS (path '{place}') "
        f"CLUSTERED BY (doc_id) INTO {buckets} BUCKETS"
    )
    spark.catalog.refreshTable(name)
    return Texts(spark.table(name), buckets)


def _name(path: str, key: str, buckets: int) -> str:
    return f"rankloom_texts_{hashlib.md5(f'{path} {key}'.encode()).hexdigest()}_{buckets}"


def fetch_texts(run: DataFrame, queries: DataFrame, texts: Texts) -> DataFrame:
    """``(qid, doc_id, rank, query, text)`` of the pairs of a run; the text is null for unknown documents."""
    asked = queries.select("qid", F.col("text").alias("query"))
    pairs = run.select("qid", "doc_id", "rank").join(asked, "qid").repartition(texts.buckets, "doc_id")
    # The hash table is made of the pairs of a bucket; texts stream past.
    return texts.table.join(pairs.hint("shuffle_hash"), "doc_id", "right").select("qid", "doc_id", "rank", "query", "text")


def score_pairs(pairs: DataFrame, scorer: PairScorer, batch: int = BATCH_PAIRS) -> DataFrame:
    """``(qid, doc_id, score, rank)`` with the scores of ``scorer``; a missing text is empty."""
    schema = run_schema(pairs.schema["qid"].dataType, pairs.schema["doc_id"].dataType).add("rank", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for start in range(0, rows.num_rows, batch):
                part = rows.slice(start, batch)
                scores = np.asarray(scorer(part.column("query").to_pylist(), part.column("text").to_pylist()), np.float64)
                if scores.shape != (part.num_rows,):
                    raise ValueError(f"the scorer gave {scores.shape} scores for {part.num_rows} pairs")
                columns = [part.column("qid"), part.column("doc_id"), pa.array(scores), part.column("rank").cast(pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    whole = pairs.select("qid", "doc_id", "rank", *[F.coalesce(c, F.lit("")).alias(c) for c in ("query", "text")])
    return whole.mapInArrow(run, schema)


def rerank_top_k(
    run: DataFrame, queries: DataFrame, texts: Texts, scorer: PairScorer, k: int, batch: int = BATCH_PAIRS
) -> DataFrame:
    """The first ``k`` documents of a run by the scorer. Equal scores keep the order of the run."""
    positive_k(k)
    scored = score_pairs(fetch_texts(run, queries, texts), scorer, batch).withColumnRenamed("rank", "before")
    order = [single_precision(F.col("score")).desc(), F.col("before").asc(), F.col("doc_id").asc()]
    return top_k(scored, k, order).select("qid", "doc_id", "score", "rank")


@dataclass(frozen=True)
class RerankedRetriever:
    """A retriever whose first ``depth`` documents are ranked anew."""

    first: object
    texts: Texts
    scorer: PairScorer
    depth: int = 100

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        found = self.first.retrieve(queries, max(positive_k(k), self.depth))
        return rerank_top_k(found, queries, self.texts, self.scorer, k)
