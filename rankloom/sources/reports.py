"""Reports of a comparison of methods. All tables here have one row per method."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.config import EvalConfig
from rankloom.operators.report import (
    LATENCY,
    best_method,
    fastest_method,
    method_wins,
    summary_columns,
)

REQUIRED_COLUMNS = ("method", "recall@10", LATENCY)


def write_csv(table: DataFrame, path: str) -> None:
    """Sorted by method, with a header and no index column."""
    table.orderBy("method").coalesce(1).write.mode("overwrite").csv(path, header=True)


def report_document(table: DataFrame, config: EvalConfig) -> DataFrame:
    """One row: the settings and the list of method rows, keys in alphabetical order."""
    settings = F.struct(
        F.lit(config.dataset).alias("dataset"),
        F.array(*[F.lit(k) for k in config.ks]).alias("ks"),
        F.lit(config.limit_queries).alias("limit_queries"),
        F.lit(config.min_relevance).alias("min_relevance"),
        F.lit(config.seed).alias("seed"),
        F.lit(config.split).alias("split"),
    )
    row = F.struct(*[F.col(f"`{name}`") for name in sorted(table.columns)])
    return table.agg(F.sort_array(F.collect_list(row)).alias("rows")).select(settings.alias("config"), "rows")


def write_json(table: DataFrame, config: EvalConfig, path: str) -> None:
    """Indented UTF-8 with sorted keys."""
    text = F.to_json(F.struct("config", "rows"), {"pretty": "true", "ignoreNullFields": "false"})
    report_document(table, config).select(text).coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Method rows of a JSON report, indented or not."""
    rows = spark.read.option("multiLine", True).json(path).select(F.inline("rows"))
    for name in REQUIRED_COLUMNS:
        if name not in rows.columns:
            raise KeyError(f"the report at {path} has no {name}, only {', '.join(rows.columns)}")
    return rows


def summary_lines(table: DataFrame) -> list[str]:
    """A Markdown page: the summary metrics of every method, and for each metric who leads by how much.

    ``table`` has one row per method. It is evaluated once; what follows works on those rows.
    """
    held = table.sparkSession.createDataFrame(table.collect(), table.schema)
    shown = summary_columns(held)
    rows = {row.method: row for row in shown.orderBy("method").collect()}
    lines = [f"# Compared: {', '.join(rows)}", "", "| " + " | ".join(shown.columns) + " |"]
    lines.append("|---" * len(shown.columns) + "|")
    for row in rows.values():
        lines.append("| " + " | ".join([row[0], *[f"{value:.4f}" for value in row[1:]]]) + " |")
    if len(rows) > 1:
        lines += ["", "| metric | leader | ahead of the next by |", "|---|---|---|"]
        for row in best_method(held).orderBy("metric").collect():
            others = [rows[name][row.metric] for name in rows if name != row.method]
            lines.append(f"| {row.metric} | {row.method} | {row.value - max(others):.4f} |")
        lines += ["", "| leader of | metrics |", "|---|---|"]
        lines += [f"| {row.method} | {row.wins} |" for row in method_wins(held).orderBy("method").collect()]
        fastest = fastest_method(held).first()
        lines += ["", f"Least time per query: {fastest.method}, {fastest[LATENCY]:.4f} ms."]
    return [*lines, ""]


def write_markdown(table: DataFrame, path: str) -> None:
    spark = table.sparkSession
    text = "\n".join(summary_lines(table))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
