"""Dropping lines that many documents share.

A text is split at line feeds. The key of a line is the line without ASCII white space at its ends, A-Z
lower-cased. Keys are exploded into rows as 128-bit hashes, and the distinct documents of every hash are
counted, with the largest id among them. A key of at least ``min_chars`` code points in at least
``min_docs`` documents loses all its lines except in the document with the largest id. What is left of a
text is put together in the order of its lines.

Only narrow rows are shuffled for counting: hash, id and place. The keys that hold most lines, fewer than
``HOT_KEYS`` whatever the data, are sent to all tasks, which drop their lines where the texts lie. The lines of
the other keys are found by a Bloom filter of bounded size and then exactly, in a shuffle where no key is
large; only texts that may lose such a line are moved, by a second Bloom filter, and rows that are equal in id
and text many times over are salted there.

Defined results: a null or empty text is one empty line. Documents are told apart by their id: rows of the
same id are one document, and so are all rows without an id, which counts as smaller than any other. A
text that loses all its lines is empty. Repeated rows each get their row and lose the same lines. Very long
texts are read whole, their keys handed on ``BLOCK_LINES`` at a time. An empty table gives an empty table.
Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rankloom.llm import bloom
from rankloom.llm.common import free_name, slices, text_bytes, without
from rankloom.llm.facts import row_key, spread
from rankloom.session import materialise

RESULTS = ("n_lines", "n_dropped", "kept")
# White space that does not count at the ends of a line.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
# Keys that may be sent to all tasks: those with more than this part of all shared lines.
HOT_KEYS = 1 << 16
BLOCK_LINES = 1 << 16
# Rows equal in id and text that one task may get in the last join.
SLICE_ROWS = 1 << 14

_CONTINUED = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Settings:
    min_chars: int = 40
    min_docs: int = 5


def line_keys(raw: bytes, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """Place and key of every line that is long enough."""
    for place, line in enumerate(raw.split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(BLANKS).lower()
            # Code points are the bytes that do not continue one.
            if len(key) >= min_chars and len(key.translate(None, _CONTINUED)) >= min_chars:
                yield place, key


def explode_keys(docs: DataFrame, settings: Settings, key: str, text: str) -> DataFrame:
    """doc, row1, row2 (a hash of id and text), place, key1, key2 (the key's hash): a row per long line."""
    rows = docs.select(
        F.col(f"`{key}`").alias("doc"),
        row_key(1, key, text).alias("row1"),
        row_key(2, key, text).alias("row2"),
        text_bytes(F.col(f"`{text}`")).alias("raw"),
    ).where(F.octet_length("raw") >= settings.min_chars)
    schema = T.StructType(
        [rows.schema["doc"]] + [T.StructField(c, T.LongType()) for c in ("row1", "row2", "place", "key1", "key2")]
    )

    def packed(batch: pa.RecordBatch, owners: list[int], places: list[int], hashes: list[bytes]) -> pa.RecordBatch:
        owner = pa.array(owners, pa.int64())
        halves = np.frombuffer(b"".join(hashes), dtype=np.int64).reshape(-1, 2)
        columns = [batch.column(c).take(owner) for c in ("doc", "row1", "row2")]
        columns += [pa.array(places, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
        return pa.RecordBatch.from_arrays(columns, names=["doc", "row1", "row2", "place", "key1", "key2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owners, places, hashes = [], [], []
            for owner, raw in enumerate(batch.column("raw")):
                for place, line in line_keys(raw.as_py(), settings.min_chars):
                    owners.append(owner)
                    places.append(place)
                    hashes.append(blake2b(line, digest_size=16).digest())
                    if len(owners) >= BLOCK_LINES:
                        yield packed(batch, owners, places, hashes)
                        owners, places, hashes = [], [], []
            if owners:
                yield packed(batch, owners, places, hashes)

    return rows.mapInArrow(run, schema)


def shared_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """key1, key2, lines, docs and last (the largest id) of keys in at least ``min_docs`` documents."""
    by_doc = lines.groupBy("key1", "key2", "doc").agg(F.count(F.lit(1)).alias("lines"))
    return (
        by_doc.groupBy("key1", "key2")
        .agg(F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("docs"), F.max("doc").alias("last"))
        .where(F.col("docs") >= min_docs)
    )


@dataclass(frozen=True)
class Shared:
    """Shared keys: ``hot`` ones with their largest id, by hash, and the table and number of the others."""

    hot: dict[bytes, object]
    cold: DataFrame
    cold_count: int


def split_keys(shared: DataFrame) -> Shared:
    """``shared`` has been written before. Fewer than HOT_KEYS keys come to the driver."""
    every, total = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum("lines"), F.lit(0))).first()
    limit = total // HOT_KEYS
    found = shared.where(F.col("lines") > limit).select("key1", "key2", "last").toArrow()
    halves = np.stack([found.column(c).to_numpy() for c in ("key1", "key2")], axis=1).astype(np.int64)
    hot = {half.tobytes(): last for half, last in zip(halves, found.column("last").to_pylist(), strict=True)}
    return Shared(hot, shared.where(F.col("lines") <= limit).select("key1", "key2", "last"), every - len(hot))


def dropped_lines(lines: DataFrame, cold: DataFrame, count: int) -> DataFrame:
    """row1, row2, copies (rows that are equal in id and text) and places (dropped lines of cold keys)."""
    blocks = bloom.block_count(count)
    found = bloom.mark(lines, "key1", bloom.build(cold, "key1", blocks), blocks).where("possible").drop("possible")
    return (
        found.join(cold, ["key1", "key2"])
        .where(~F.col("doc").eqNullSafe(F.col("last")))
        .groupBy("row1", "row2")
        .agg(F.collect_set("place").alias("places"), F.count(F.lit(1)).alias("n"))
        .select("row1", "row2", (F.col("n") / F.size("places")).cast("long").alias("copies"), "places")
    )


def drop_lines(
    docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with n_lines (before dropping), n_dropped and kept, the text that is left."""
    rows = without(docs, *RESULTS)
    lines = explode_keys(rows, settings, key, text)
    shared = split_keys(materialise(shared_keys(lines, settings.min_docs), "line-keys"))
    places = free_name(rows, "places")
    if shared.cold_count:
        dropped = dropped_lines(lines, shared.cold, shared.cold_count).withColumnRenamed("places", places)
        dropped = materialise(dropped, "line-drops")
        here, moved = spread(rows, dropped, (key, text), places, SLICE_ROWS)
        return _cut(here, settings, shared.hot, key, text).unionByName(_cut(moved, settings, shared.hot, key, text, places))
    return _cut(rows, settings, shared.hot, key, text)


def _cut(
    rows: DataFrame, settings: Settings, hot: dict[bytes, object], key: str, text: str, places: str | None = None
) -> DataFrame:
    """``rows`` with n_lines, n_dropped and kept: without lines of hot keys, and without those at ``places``."""
    names = [c for c in rows.columns if c != places]
    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())]
    schema = T.StructType([rows.schema[n] for n in names] + added)
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lasts = shared.value
        for batch in slices(batches, 128):
            n_lines, n_dropped, kept = [], [], []
            listed = batch.column(places) if places else pa.nulls(batch.num_rows)
            texts = batch.column(text).cast(pa.binary())
            for doc, raw, gone in zip(batch.column(key), texts, listed, strict=True):
                body = raw.as_py() or b""
                dropped = set(gone.as_py() or ())
                for place, line in line_keys(body, settings.min_chars) if lasts else ():
                    hashed = blake2b(line, digest_size=16).digest()
                    if hashed in lasts and lasts[hashed] != doc.as_py():
                        dropped.add(place)
                n_lines.append(body.count(b"\n") + 1)
                n_dropped.append(len(dropped))
                if dropped:
                    body = b"\n".join(line for place, line in enumerate(body.split(b"\n")) if place not in dropped)
                kept.append(body)
            columns = [batch.column(n) for n in names]
            columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
