"""A training corpus from raw documents: filter, deduplicate, decontaminate, mix and shard.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it is written as Parquet
and read again, so a lost executor never costs more than one stage.

Null and empty texts, very long ones, repeated rows, ties, empty tables and further columns are treated as the
operators say: nothing is dropped on account of them. The classifier scores a null text as an empty one; null
texts and texts without words are nobody's near copy and hold no benchmark window; of rows equal in id and text
the near-duplicate stage keeps one; the mix draws a text without words by chance of its place like any other. All
stages but the last return the columns they were given; the last adds its own, in place of columns of the same
names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankloom.llm import decontaminate, mixing, ngram_join, quality, sharding
from rankloom.llm.common import free_name, table
from rankloom.llm.queries import SHARDS, fold
from rankloom.session import materialise, remove_scratch, scratch_path, scratch_scope


def _aside(docs: DataFrame, results: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns of the names of ``results`` under other names, and the columns as they were."""
    taken = {name.lower() for name in results}
    named = docs
    for name in docs.columns:
        if name.lower() in taken:
            named = named.withColumnRenamed(name, free_name(named, f"own_{name}"))
    return named, [F.col(f"`{now}`").alias(was) for now, was in zip(named.columns, docs.columns, strict=True)]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from labelled documents of the stage."""
    labels = table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(fold(5) != 0))
    named, columns = _aside(docs, quality.RESULTS)
    return quality.score(named, model, threshold=0.3).where("predicted = 1").select(*columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word n-grams, similarity 0.8 or more."""
    return ngram_join.keep_one(docs, materialise(ngram_join.join(docs), "ngram-decisions"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    named, columns = _aside(docs, decontaminate.RESULTS)
    found = decontaminate.scan(named, table(spark, sf_dir, "benchmark"))
    return found.where("NOT contaminated").select(*columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, 150 % of all words by source weights 3, 1, 2."""
    named, columns = _aside(docs, (*mixing.RESULTS, "copy"))
    drawn = mixing.mix(named, mixing.cycled_weights(named, (3, 1, 2)), share=1.5, cap=2.0)
    return mixing.emit(drawn).select(*columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their place in it."""
    return sharding.shard(docs, SHARDS, scratch_path(spark, "shard-map"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed),
    ("sharding", sharded),
]

# A learned classifier and seeded hashes have no counterpart in SQL; the tests compare each stage with
# a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        label = name.replace(" ", "-")
        path = scratch_path(spark, label)
        # What a stage writes on its way is deleted once its own result is written, and so is the one before.
        with scratch_scope(spark):
            docs = materialise(stage(spark, docs, sf_dir), label, path)
        if before:
            remove_scratch(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
