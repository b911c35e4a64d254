"""License scans by diagonal voting.

Every pair of neighbouring words of a document is hashed and joined with the places where the same pair
stands in a template, a known phrase or licence notice. A joined pair votes for the diagonal
``place in the document - place in the template``. Votes are distinct template places per (document,
template, diagonal). Neighbouring diagonals, where words were put in or left out, are merged into one
span, and a span counts if it covers enough of the template. The words of joined pairs are compared
themselves, so equal hashes of different words never vote, and a whole diagonal proves the phrase.

Templates are a short list written by hand, so their table is broadcast. Only pairs that occur in a
template leave the scan; a document with very many of them is spread over tasks by diagonal and place
until its votes are counted. Documents are told apart by id and text, so rows equal in both share
their result.

Defined results: null and empty texts have no words, no places, empty labels and score 0. A document
of one word has no pair. A very long text is scanned whole, its pairs as rows. Equal votes need no choice: all
spans count. Repeated rows are all returned. An empty table gives an empty table. Only the
named columns of the documents are read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rankloom.llm.common import WORD, ascii_lower

GRAM = 2
# Diagonals this far apart belong together: so many words may be put in or left out at one place.
DRIFT = 2
# Part of a notice's word pairs that a span must cover.
COVERAGE = 0.8


class Template(NamedTuple):
    """``exact`` phrases count only whole, on one diagonal; notices by coverage."""

    label: str
    text: str
    exact: bool = False


# Phrases and their labels.
PHRASES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)

# Usual one-line notices and opening lines of licences.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2"),
    Template("cc-by-4.0", "licensed under cc by 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)

_DOC = ["doc_id", "__print", "__len"]


def template_places(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """template, place, first and second word, their hash: one row for each word pair of a template."""
    rows = []
    for number, template in enumerate(templates):
        words = [w.decode() for w in re.findall(WORD.encode(), template.text.lower().encode())]
        if len(words) < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {template}")
        rows += [(number, place, *words[place : place + GRAM]) for place in range(len(words) - GRAM + 1)]
    frame = spark.createDataFrame(rows, "template int, place int, first string, second string")
    return frame.withColumn("gram", F.xxhash64("first", "second"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(ascii_lower(text), F.lit("")), F.lit(WORD), F.lit(0))


def word_pairs(docs: DataFrame) -> DataFrame:
    """at, first, second and gram for every pair of neighbouring words; one row each, streamed."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("words") - GRAM),
        lambda i: F.struct(F.get("words", i).alias("first"), F.get("words", i + 1).alias("second")),
    )
    return (
        docs.select(*_DOC, _words(F.col("text")).alias("words"))
        .where(F.size("words") >= GRAM)
        .select(*_DOC, F.posexplode(pairs).alias("at", "pair"))
        .select(*_DOC, "at", "pair.first", "pair.second")
        .withColumn("gram", F.xxhash64("first", "second"))
    )


def spans(docs: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """doc, template, start and coverage of every span; coverage is 1 for a whole template."""
    spark = docs.sparkSession
    lengths = spark.createDataFrame(
        [(k, len(re.findall(WORD, t.text.lower())) - GRAM + 1, t.exact) for k, t in enumerate(templates)],
        "template int, grams int, exact boolean",
    )
    votes = (
        word_pairs(docs)
        .join(F.broadcast(template_places(spark, templates)), ["gram", "first", "second"])
        .groupBy(*_DOC, "template", (F.col("at") - F.col("place")).alias("diagonal"))
        .agg(F.collect_set("place").alias("places"))  # no more than the template has
        .join(F.broadcast(lengths), "template")
        .where(~F.col("exact") | (F.size("places") == F.col("grams")))
    )
    along = Window.partitionBy(*_DOC, "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along)
    fresh = F.when(F.col("exact") | apart.isNull() | (apart > DRIFT), 1).otherwise(0)
    return (
        votes.withColumn("fresh", fresh)
        .withColumn("span", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*_DOC, "template", "exact", "span")
        .agg(
            F.min("diagonal").alias("start"),
            # Neighbouring diagonals of one span are few unless a notice is repeated word by word.
            (F.size(F.array_distinct(F.flatten(F.collect_list("places")))) / F.first("grams")).alias("coverage"),
        )
    )


def scan(
    docs: DataFrame,
    phrases: Sequence[Template] = PHRASES,
    notices: Sequence[Template] = NOTICES,
    coverage: float = COVERAGE,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per document.

    Base columns are about the phrases. ``score`` is the best coverage of any template, 0 without a vote.
    """
    templates = [*(t._replace(exact=True) for t in phrases), *(t._replace(exact=False) for t in notices)]
    spark = docs.sparkSession
    body = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), body.alias("text")).withColumns(
        {"__print": F.xxhash64("text"), "__len": F.coalesce(F.length("text"), F.lit(-1))}
    )
    labels = spark.createDataFrame([(k, t.label) for k, t in enumerate(templates)], "template int, label string")
    found = (
        spans(rows, templates)
        .join(F.broadcast(labels), "template")
        .groupBy(*_DOC)
        .agg(
            F.count(F.when(F.col("exact"), 1)).alias("n_base"),
            F.min(F.when(F.col("exact"), F.col("start"))).alias("first_word"),
            F.max(F.when(F.col("exact"), F.col("start"))).alias("last_word"),
            F.collect_set(F.when(F.col("exact"), F.col("label"))).alias("base"),
            F.collect_set(F.when(F.col("exact") | (F.col("coverage") >= coverage), F.col("label"))).alias("all"),
            F.max("coverage").alias("score"),
        )
    )
    counted = rows.select(
        *_DOC, F.regexp_count(F.coalesce(ascii_lower(F.col("text")), F.lit("")), F.lit(WORD)).cast("long").alias("n_words")
    )
    same = [counted[c].eqNullSafe(found[c]) for c in _DOC]
    none = F.array().cast("array<string>")
    return counted.join(found, same, "left").select(
        counted["doc_id"],
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long"),
        F.col("last_word").cast("long"),
        F.array_join(F.array_sort(F.coalesce("base", none)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.coalesce("all", none)), ",").alias("labels"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
