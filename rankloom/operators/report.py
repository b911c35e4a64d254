"""Comparison of methods: from the wide metric table to what a report shows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

# Order of methods in which equal results are decided; others follow by name.
METHOD_ORDER = ("bm25", "dense", "hybrid")
SUMMARY_METRICS = ("recall", "mrr")
LATENCY = "avg_latency_ms"


def method_position(method: str = "method"):
    place = F.array_position(F.array(*[F.lit(name) for name in METHOD_ORDER]), F.col(method))
    return F.when(place > 0, place.cast("int")).otherwise(F.lit(len(METHOD_ORDER) + 1))


def method_table(metrics: DataFrame, latency: DataFrame) -> DataFrame:
    """Wide metrics with the latency, one row per method, sorted by method."""
    return (
        metrics.join(latency.select("method", LATENCY), "method", "left")
        .withColumn(LATENCY, F.coalesce(LATENCY, F.lit(0.0)))
        .orderBy("method")
    )


def summary_names(columns: Sequence[str]) -> list[str]:
    return [name for name in columns if name.startswith(tuple(f"{metric}@" for metric in SUMMARY_METRICS))]


def summary_columns(table: DataFrame) -> DataFrame:
    """The part of the table a summary shows: recall, reciprocal rank and latency."""
    shown = [*summary_names(table.columns), LATENCY]
    return table.select("method", *[F.col(f"`{name}`") for name in shown])


def summary_long(table: DataFrame) -> DataFrame:
    names = summary_names(table.columns)
    entries = F.array(
        *[F.struct(F.lit(name).alias("metric"), F.col(f"`{name}`").alias("value")) for name in names]
    )
    return table.select("method", F.inline(entries))


def best_method(table: DataFrame) -> DataFrame:
    """Method with the highest value per summary metric; the earlier method wins a tie."""
    order = Window.partitionBy("metric").orderBy(
        F.col("value").desc(), method_position().asc(), F.col("method").asc()
    )
    return (
        summary_long(table)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") == 1)
        .select("metric", "method", "value")
    )


def method_wins(table: DataFrame) -> DataFrame:
    """How many summary metrics each method leads, 0 included."""
    wins = best_method(table).groupBy("method").agg(F.count(F.lit(1)).alias("wins"))
    return table.select("method").join(wins, "method", "left").select(
        "method", F.coalesce("wins", F.lit(0)).cast("bigint").alias("wins")
    )


def fastest_method(table: DataFrame) -> DataFrame:
    """Method with the lowest latency; the earlier method wins a tie."""
    key = F.struct(F.col(LATENCY), method_position(), F.col("method"))
    return table.agg(
        F.min_by("method", key).alias("method"),
        F.min(LATENCY).alias(LATENCY),
    ).where(F.col("method").isNotNull())


def chart_table(table: DataFrame, metric: str = "recall@10") -> DataFrame:
    """Two panels in long form, ready to draw: one metric and the latency of every method."""
    panels = F.array(
        *[
            F.struct(F.lit(name).alias("panel"), F.col(f"`{name}`").cast("double").alias("value"))
            for name in (metric, LATENCY)
        ]
    )
    return table.select("method", F.inline(panels)).select("panel", "method", "value")
