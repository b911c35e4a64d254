"""Score arithmetic shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fused scores are compared at this many decimals, so the order of summation cannot decide a tie.
FUSION_DIGITS = 12


def single_precision(score: Column) -> Column:
    """Ranking key of a retrieval score.

    Scores are compared in single precision. Sums that differ only in the order of their terms
    then tie, whatever the size of the scores, and the document id decides.
    """
    return score.cast("float")


def inverse_document_frequency(n_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def saturation(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    """Saturated term frequency with length normalisation, in [0, 1)."""
    return tf / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avgdl))


def reciprocal_rank(weight: Column, rank: Column, rrf_k: int) -> Column:
    return weight / (F.lit(rrf_k) + rank)


def discount(rank: Column) -> Column:
    """Gain of a relevant document at a 1-based rank."""
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def ideal_dcg(n_relevant: Column, k: Column) -> Column:
    """DCG of the best possible ranking: the first ``min(n_relevant, k)`` places all relevant."""
    places = F.least(n_relevant.cast("int"), k)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(places, F.lit(1))), F.lit(0.0), lambda total, rank: total + discount(rank))
    return F.when(places >= 1, ideal).otherwise(F.lit(0.0))
