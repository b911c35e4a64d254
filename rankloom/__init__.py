"""Retrieval analytics on Spark: index, search, fuse, evaluate and report as DataFrame jobs."""

from rankloom.config import (
    Bm25Config,
    DatasetConfig,
    DenseConfig,
    EvalConfig,
    HybridConfig,
)

__all__ = ["Bm25Config", "DatasetConfig", "DenseConfig", "EvalConfig", "HybridConfig"]
