"""Retrievers answer a whole set of queries at once."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, functions as F

from rankloom.config import Bm25Config, DenseConfig, HybridConfig
from rankloom.functions.guards import positive_k
from rankloom.operators.dense import check_dimensions, dense_places, dense_top_k
from rankloom.operators.fusion import rrf_top_k
from rankloom.operators.lexical import TextIndex, bm25_places, bm25_top_k


class Retriever(Protocol):
    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        """``queries(qid, text)`` to a run ``(qid, doc_id, score, rank)``, rank from 1."""
        ...


@dataclass(frozen=True)
class Bm25Retriever:
    index: TextIndex
    config: Bm25Config = Bm25Config()

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        return bm25_top_k(self.index, queries, k, self.config)

    def places(self, queries: DataFrame, pairs: DataFrame) -> DataFrame | None:
        """``(qid, doc_id, rank)`` of ``pairs(qid, doc_id)`` in the whole lists; none where the index has no blocks."""
        return bm25_places(self.index, queries, pairs, self.config) if self.index.blocks else None


@dataclass(frozen=True)
class DenseRetriever:
    """``encode_queries`` turns ``(qid, text)`` into ``(qid, embedding)`` with the encoder that
    made the index."""

    vectors: DataFrame
    encode_queries: Callable[[DataFrame], DataFrame]
    config: DenseConfig = DenseConfig()

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        positive_k(k)
        encoded = self.encode_queries(queries)
        return dense_top_k(encoded, self.vectors, k, self.config)

    def places(self, queries: DataFrame, pairs: DataFrame) -> DataFrame | None:
        """``(qid, doc_id, rank)`` of ``pairs(qid, doc_id)`` in the whole lists; none where ids repeat or are missing."""
        counts = self.vectors.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        if counts.where((F.col("n") > 1) | F.col("doc_id").isNull()).limit(1).count():
            return None
        return dense_places(self.encode_queries(queries), self.vectors, pairs, self.config)

    def check(self, queries: DataFrame) -> None:
        """Compare the dimensions of all vectors; a search itself compares one of each side before it
        starts, and every block as it goes."""
        check_dimensions(self.vectors, self.encode_queries(queries))


@dataclass(frozen=True)
class FusedRetriever:
    """Any retrievers by name, fused; every name needs a weight in ``config``."""

    sides: Mapping[str, Retriever]
    config: HybridConfig = HybridConfig()

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        depth = self.config.fetch_depth(positive_k(k))
        for name in self.sides:
            self.config.weight(name)
        runs = {name: side.retrieve(queries, depth) for name, side in self.sides.items()}
        return rrf_top_k(runs, k, self.config)


@dataclass(frozen=True)
class HybridRetriever:
    """The two usual sides."""

    bm25: Retriever
    dense: Retriever
    config: HybridConfig = HybridConfig()

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        return FusedRetriever({"bm25": self.bm25, "dense": self.dense}, self.config).retrieve(queries, k)
