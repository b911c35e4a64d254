"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Words of a text after A-Z have been lower-cased: ASCII digits and letters, and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_BYTES = re.compile(WORD.encode("ascii"))

# Rows of one Arrow batch handed to Python. Texts can be very long; few rows bound the memory.
BATCH_ROWS = 512

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Null stays null."""
    return F.translate(text, _UPPER, _UPPER.lower())


def text_bytes(text: str | Column = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def words_of(raw: bytes) -> list[bytes]:
    """The words of UTF-8 bytes, A-Z lower-cased (``bytes.lower`` leaves other bytes alone)."""
    return WORD_BYTES.findall(raw.lower())


def slices(batches: Iterator, rows: int = BATCH_ROWS) -> Iterator:
    """Arrow batches cut into pieces of a few rows, so that what Python builds from one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use yet, whatever its case."""
    used = {column.lower() for column in df.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names the caller is about to give to its own results."""
    taken = {name.lower() for name in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
