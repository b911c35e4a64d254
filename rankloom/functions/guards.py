"""Argument checks made on the driver, before any plan is built."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


def positive_k(k: int) -> int:
    if k <= 0:
        raise ValueError("k must be positive")
    return k


def positive_ks(ks: Iterable[int]) -> tuple[int, ...]:
    cutoffs = tuple(ks)
    if not cutoffs or any(k <= 0 for k in cutoffs):
        raise ValueError("ks must be positive")
    return cutoffs


def deep_enough(depth: int, ks: Sequence[int]) -> int:
    """A run must reach the largest cut-off it is measured at."""
    needed = max(positive_ks(ks))
    if depth < needed:
        raise ValueError(f"retrieval depth must be >= {needed}: metrics are computed at k in {sorted(ks)}")
    return depth
