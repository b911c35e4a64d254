"""Benchmark decontamination by Wu-Manber search for many patterns at once.

The symbols are words. Patterns are all windows of ten consecutive words of a test item; an item of
fewer words is one pattern of its own length. Patterns of one length share three tables: a shift per
block of words, saying how far the search may jump when it meets the block, the patterns that end in a
block whose shift is 0, and the items of every pattern. Where the shift is 0, the words themselves are
compared with each pattern of that block.

Documents stay where they are: each task searches its own. The items come to the driver in slices of
a measured size, so neither a worker nor the driver holds more than one slice. With several slices, each reads
the documents' texts and writes down only what it finds, by a hash of the text: ranges and items, never
the text itself. What was found is then taken back to the documents that hold it; all others do not move.

Defined results: null and empty texts have no words, no hits and are clean. Items without words are
never found. Repeated items, and items that share a window, are each counted where it occurs; an item
without id has the empty name. Overlapping occurrences are hit once, and a very long text is searched whole.
Repeated documents each get their row. Empty tables are fine on either
side. Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from rankloom.llm.common import free_name, slices, text_bytes, words_of
from rankloom.llm.facts import row_key, spread
from rankloom.session import materialise

WINDOW = 10
BLOCK = 2
# Bytes of item text per slice: some five thousand ordinary items, about 100 MB of tables in a worker.
SLICE_BYTES = 1 << 20

RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits", "items")


class Patterns:
    """Search tables for patterns of one length."""

    def __init__(self, length: int, owners: dict[tuple[bytes, ...], set[str]]):
        self.length = length
        self.block = block = min(BLOCK, length)
        self.owners = owners
        self.jump = length - block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.ending: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = defaultdict(list)
        for pattern in owners:
            for end in range(block, length + 1):
                part = pattern[end - block : end]
                self.shift[part] = min(self.shift.get(part, self.jump), length - end)
            self.ending[pattern[length - block :]].append(pattern)

    def search(self, words: Sequence[bytes]) -> Iterator[tuple[int, set[str]]]:
        """Start and items of every occurrence, from left to right."""
        length, block, jump, shift = self.length, self.block, self.jump, self.shift
        end, last = length, len(words)
        while end <= last:
            part = tuple(words[end - block : end])
            step = shift.get(part, jump)
            if step:
                end += step
                continue
            here = tuple(words[end - length : end])
            for pattern in self.ending[part]:
                if pattern == here:
                    yield end - length, self.owners[pattern]
            end += 1


def build(items: Sequence[tuple[str, bytes]], window: int = WINDOW) -> list[Patterns]:
    """Search tables by pattern length, from (item, text) pairs."""
    lengths: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, raw in items:
        words = words_of(raw)
        size = min(window, len(words))
        for start in range(len(words) - size + 1 if words else 0):
            lengths[size][tuple(words[start : start + size])].add(item)
    return [Patterns(size, dict(owners)) for size, owners in sorted(lengths.items())]


def _find(words: Sequence[bytes], tables: Sequence[Patterns]) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges hit, merged where they meet, and the items found."""
    ranges, found = [], set()
    for patterns in tables:
        for start, owners in patterns.search(words):
            ranges.append((start, start + patterns.length))
            found |= owners
    return merge(ranges), found


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RANGE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_SEARCHED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(_RANGE)),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


# Search tables of the slice a worker has last seen.
_built: dict[str, list[Patterns]] = {}


def _tables(name: str, shared: Broadcast, window: int) -> list[Patterns]:
    """Built once per worker and slice, not once per task."""
    if name not in _built:
        _built.clear()
        _built[name] = build(shared.value, window)
    return _built[name]


def _search_pass(rows: DataFrame, items: Sequence[tuple[str, bytes]], text: str, state: str, window: int) -> DataFrame:
    """One pass: ranges and items of this slice are added to what column ``state`` holds."""
    shared, name = rows.sparkSession.sparkContext.broadcast(list(items)), uuid.uuid4().hex
    schema = T.StructType([f for f in rows.schema.fields if f.name != state] + [T.StructField(state, _SEARCHED)])
    kind = pa.struct([("n_words", pa.int64()), ("hits", _RANGES), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(name, shared, window)
        for batch in slices(batches):
            texts, before = batch.column(text).cast(pa.binary()).to_pylist(), batch.column(state).to_pylist()
            out = []
            for raw, seen in zip(texts, before, strict=True):
                words = words_of(raw or b"")
                hits, found = _find(words, tables)
                if seen:
                    hits = merge(hits + [(r["start"], r["end"]) for r in seen["hits"]])
                    found |= set(seen["items"])
                ranges = [{"start": a, "end": b} for a, b in hits]
                out.append({"n_words": len(words), "hits": ranges, "items": sorted(found)})
            others = [c for c in batch.schema.names if c != state]
            columns = [batch.column(c) for c in others] + [pa.array(out, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, state])

    return rows.mapInArrow(run, schema)


def _found_by_text(docs: DataFrame, slices_of_items: Iterator[list[tuple[str, bytes]]], text: str, state: str, window: int) -> DataFrame:
    """row1, row2 (hashes of the text), copies and ``state`` of texts with hits, from one pass per slice."""
    texts = docs.select(
        F.col(f"`{text}`").alias("text"), row_key(1, text).alias("row1"), row_key(2, text).alias("row2"), F.lit(None).cast(_SEARCHED).alias(state)
    )
    found = None
    for items in slices_of_items:
        hit = _search_pass(texts, items, "text", state, window).where(F.size(F.col(state)["hits"]) > 0).drop("text")
        # Equal texts have equal hits.
        hit = hit.groupBy("row1", "row2").agg(F.count(F.lit(1)).alias("copies"), F.first(state).alias(state))
        hit = materialise(hit, "decontaminate-hits")
        found = hit if found is None else found.unionByName(hit)
    parts = found.groupBy("row1", "row2").agg(F.max("copies").alias("copies"), F.collect_list(state).alias("parts"))
    whole = F.struct(
        F.col("parts")[0]["n_words"].alias("n_words"),
        F.flatten(F.col("parts.hits")).alias("hits"),
        F.array_distinct(F.flatten(F.col("parts.items"))).alias("items"),
    )
    return materialise(parts.select("row1", "row2", "copies", whole.cast(_SEARCHED).alias(state)), "decontaminate-found")


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    slice_bytes: int = SLICE_BYTES,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated, hits and items.

    ``hits`` are word ranges [start, end) inside occurrences, ``items`` the names of items found.
    """
    tests = benchmark.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"),
        text_bytes(item_text).alias("raw"),
    )
    size = tests.agg(F.coalesce(F.sum(F.octet_length("raw") + F.octet_length("item")), F.lit(0))).first()[0]
    count = max(1, -(-size // slice_bytes))
    part = F.pmod(F.xxhash64("item", "raw"), F.lit(count))

    keep = [c for c in docs.columns if c.lower() not in RESULTS]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    state = free_name(rows, "state")
    cut = ([(r["item"], bytes(r["raw"])) for r in tests.where(part == number).toLocalIterator()] for number in range(count))
    if count == 1:
        rows = _search_pass(rows.withColumn(state, F.lit(None).cast(_SEARCHED)), next(cut), text, state, window)
    else:
        others, met = spread(rows, _found_by_text(rows, cut, text, state, window), (text,), state)
        rows = others.withColumn(state, F.lit(None).cast(_SEARCHED)).unionByName(met)
        # Counts the words and merges the ranges of all slices.
        rows = _search_pass(rows, [], text, state, window)
    covered = F.aggregate(
        F.col(f"{state}.hits"), F.lit(0).cast("long"), lambda total, r: total + r["end"] - r["start"]
    )
    return rows.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(f"{state}.n_words").alias("n_words"),
        covered.alias("n_hit"),
        F.size(f"{state}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{state}.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(f"{state}.hits") > 0).alias("contaminated"),
        F.col(f"{state}.hits").alias("hits"),
        F.col(f"{state}.items").alias("items"),
    )
