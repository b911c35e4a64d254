"""Retrieval datasets on disk: corpus and queries as JSON lines, judgments as TSV."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from rankloom.config import DatasetConfig
from rankloom.schemas import CORPUS_FILE, QRELS_FILE, QUERIES_FILE
from rankloom.session import scratch_path


def corpus_path(dataset: DatasetConfig) -> str:
    return f"{dataset.base_dir}/{dataset.name}/corpus.jsonl"


def queries_path(dataset: DatasetConfig) -> str:
    return f"{dataset.base_dir}/{dataset.name}/queries.jsonl"


def qrels_path(dataset: DatasetConfig) -> str:
    return f"{dataset.base_dir}/{dataset.name}/qrels/{dataset.split}.tsv"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, title, text)``; a missing title or text is empty. Broken lines raise."""
    rows = spark.read.schema(CORPUS_FILE).option("mode", "FAILFAST").json(path)
    return rows.select(
        F.col("_id").alias("doc_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(QUERIES_FILE).option("mode", "FAILFAST").json(path)
    return rows.select(F.col("_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text"))


def binary_qrels(scored: DataFrame, min_relevance: int = 1) -> DataFrame:
    """Distinct relevant pairs of ``scored(qid, doc_id, score)``."""
    return scored.where(F.col("score") >= min_relevance).select("qid", "doc_id").distinct()


def read_qrels(spark: SparkSession, path: str, min_relevance: int = 1) -> DataFrame:
    """``(qid, doc_id)``: a graded judgment counts if its score reaches the threshold."""
    rows = spark.read.schema(QRELS_FILE).option("mode", "FAILFAST").csv(path, sep="\t", header=True)
    scored = rows.select(
        F.col("`query-id`").alias("qid"), F.col("`corpus-id`").alias("doc_id"), F.col("score")
    )
    return binary_qrels(scored, min_relevance)


_BROKEN = "_broken"
# Rejected lines that an error shows.
_SHOWN = 3


class TooManyRejected(RuntimeError):
    """More lines of a file were rejected than the caller puts up with."""


@dataclass(frozen=True)
class Checked:
    """The good rows of a file, ``rejected(reason, line)`` for the others, and the number of each.

    A broken line has the reason ``malformed`` and its text, a row without an id ``no id`` and what it holds.
    """

    good: DataFrame
    rejected: DataFrame
    n_good: int
    n_rejected: int


def _split(spark: SparkSession, parsed: DataFrame, good: list[Column], has_id: Column, most: float, path: str) -> Checked:
    """One read of the file: every row is parsed once and written to one of two folders, counted on the way."""
    names = [c for c in parsed.columns if c != _BROKEN]
    reason = F.when(F.col(_BROKEN).isNotNull(), "malformed").when(~F.coalesce(has_id, F.lit(False)), "no id")
    line = F.coalesce(F.col(_BROKEN), F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])))
    rows = parsed.select(
        *good, reason.alias("reason"), F.when(reason.isNotNull(), line).alias("line"), reason.isNotNull().alias("is_rejected")
    )
    seen = Observation()
    counted = rows.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("is_rejected"), 1)).alias("rejected")
    )
    folder = scratch_path(spark, "checked-rows")
    counted.write.partitionBy("is_rejected").parquet(folder)
    total, lost = seen.get["rows"], seen.get["rejected"]
    written = spark.read.schema(rows.schema).parquet(folder) if total else spark.createDataFrame([], rows.schema)
    rejected = written.where("is_rejected").select("reason", "line")
    if lost > most * total:
        shown = "; ".join(f"{r.reason}: {r.line[:200]}" for r in rejected.orderBy("line").limit(_SHOWN).collect())
        raise TooManyRejected(f"{lost} of {total} lines of {path} are rejected: {shown}")
    return Checked(written.where("NOT is_rejected").drop("reason", "line", "is_rejected"), rejected, total - lost, lost)


def _with_broken(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])


def check_corpus(spark: SparkSession, path: str, most: float = 1.0) -> Checked:
    """As :func:`read_corpus`, but lines that cannot be read are set aside. With more than the part ``most`` of
    all lines rejected, an error shows some of them. Starts a job."""
    parsed = spark.read.schema(_with_broken(CORPUS_FILE)).option("columnNameOfCorruptRecord", _BROKEN).json(path)
    good = [
        F.col("_id").alias("doc_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("text", F.lit("")).alias("text"),
    ]
    return _split(spark, parsed, good, F.col("_id").isNotNull(), most, path)


def check_queries(spark: SparkSession, path: str, most: float = 1.0) -> Checked:
    """As :func:`read_queries`, with rejected lines as in :func:`check_corpus`."""
    parsed = spark.read.schema(_with_broken(QUERIES_FILE)).option("columnNameOfCorruptRecord", _BROKEN).json(path)
    good = [F.col("_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text")]
    return _split(spark, parsed, good, F.col("_id").isNotNull(), most, path)


def check_qrels(spark: SparkSession, path: str, min_relevance: int = 1, most: float = 1.0) -> Checked:
    """As :func:`read_qrels`, with rejected lines as in :func:`check_corpus`; ``n_good`` counts lines, not pairs."""
    parsed = (
        spark.read.schema(_with_broken(QRELS_FILE))
        .option("columnNameOfCorruptRecord", _BROKEN)
        .csv(path, sep="\t", header=True)
    )
    good = [F.col("`query-id`").alias("qid"), F.col("`corpus-id`").alias("doc_id"), F.col("score")]
    there = F.col("`query-id`").isNotNull() & F.col("`corpus-id`").isNotNull()
    found = _split(spark, parsed, good, there, most, path)
    return Checked(binary_qrels(found.good, min_relevance), found.rejected, found.n_good, found.n_rejected)


def load_dataset(
    spark: SparkSession, dataset: DatasetConfig, min_relevance: int = 1
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, queries and judgments of one split."""
    return (
        read_corpus(spark, corpus_path(dataset)),
        read_queries(spark, queries_path(dataset)),
        read_qrels(spark, qrels_path(dataset), min_relevance),
    )
