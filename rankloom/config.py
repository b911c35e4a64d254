"""Frozen settings, held on the driver and read while a plan is built."""

from __future__ import annotations

from dataclasses import dataclass

DEFAULT_SEED = 42


@dataclass(frozen=True)
class DatasetConfig:
    """Where a retrieval dataset lies: ``base_dir/name/{corpus,queries}.jsonl`` and its judgments."""

    base_dir: str = "data/beir"
    name: str = "scifact"
    split: str = "test"


@dataclass(frozen=True)
class Bm25Config:
    """Term saturation, length normalisation and the weight of each text field."""

    k1: float = 1.2
    b: float = 0.75
    boosts: tuple[tuple[str, float], ...] = (("title", 2.0), ("text", 1.0))
    # Query words go to the postings in slices of at most about this many bytes.
    broadcast_bytes: int = 64 << 20
    # Leave out of a written index what upper bounds show to be below the first k. The run is the same.
    prune: bool = True

    @property
    def fields(self) -> tuple[str, ...]:
        return tuple(name for name, _ in self.boosts)


@dataclass(frozen=True)
class DenseConfig:
    """Vector width, encoder batch size and how much of the query side is sent at once."""

    dim: int = 256
    batch_size: int = 64
    normalize: bool = True
    # Query vectors with their k best rows go to the vectors in slices of at most about this many
    # bytes; a lookup table beyond it is never broadcast.
    broadcast_bytes: int = 64 << 20


@dataclass(frozen=True)
class HybridConfig:
    """Reciprocal rank fusion: smoothing constant, side weights and how deep each side is read.

    ``more_weights`` names the weights of sides other than bm25 and dense. A side is never read less
    deep than k rows; ``max_fetch`` only limits what is read beyond that.
    """

    rrf_k: int = 60
    bm25_weight: float = 1.0
    dense_weight: float = 1.0
    more_weights: tuple[tuple[str, float], ...] = ()
    over_fetch: int = 2
    max_fetch: int | None = None

    def fetch_depth(self, k: int) -> int:
        deep = k * self.over_fetch
        return max(k, deep if self.max_fetch is None else min(deep, self.max_fetch))

    @property
    def weights(self) -> dict[str, float]:
        return {"bm25": self.bm25_weight, "dense": self.dense_weight, **dict(self.more_weights)}

    def weight(self, method: str) -> float:
        if method not in self.weights:
            raise ValueError(f"no fusion weight for {method!r}; there are weights for {', '.join(self.weights)}")
        return self.weights[method]


@dataclass(frozen=True)
class EvalConfig:
    """Which queries are evaluated and at which cut-offs.

    All judged queries, unless ``limit_queries`` asks for a sample. ``min_relevance`` is applied to
    judgments that come with a score.
    """

    dataset: str = "scifact"
    split: str = "test"
    limit_queries: int = 0
    seed: int = DEFAULT_SEED
    ks: tuple[int, ...] = (1, 3, 5, 10)
    min_relevance: int = 1
