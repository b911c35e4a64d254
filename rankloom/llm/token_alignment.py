"""Aligning the tokens of two tokenizers, with a fast path for tokens that both have.

Tokenizer A encodes a blank and the text, tokenizer B the text, to which it adds the blank itself. Byte
offsets where tokens of both end cut the tokens into groups; every A token of a group is linked with every
B token of it. A pair of ids counts once per document that holds it linked.

Before anything else, an array as long as A's vocabulary says which B id has the same bytes. Groups of one
token on either side nearly always hold such a pair: they are counted in vectors as long as the vocabulary,
one per task, and never meet a shuffle. Only pairs of other groups are shuffled, added up per task before.
Pairs that are held by more than one in ``HOT_PAIRS`` of all such links number fewer than that, whatever
the data: their counts go to the documents together with the vectors. The remaining rare pairs meet
their counts in a shuffle, where none of them is large.

Texts are encoded once. What is linked in a document is written as distinct ids and pairs, with how
often each occurs; documents are scored from there. A long text is cut before a single blank between two
word characters, ``CHUNK`` characters or more apart: there a piece of A begins, and no piece of B reaches
across a blank, so both encode the parts as they encode the whole. A vocabulary B that has such pieces is
recognised, and texts are then encoded whole. Large groups are never expanded into pairs of occurrences:
their ids are counted first, and pairs of ids are formed ``BLOCK_PAIRS`` at a time.

Defined results: null and empty texts, and those whose joined token bytes in A or B are not the blank and
the text, have no tokens: zeros and an empty check sum. Rows are documents, whether their ids repeat or
not, and each gets its row. Equal counts are all an A id's highest. An empty table gives an empty table.
Only the named columns are read; the result has the key and its own columns.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rankloom.llm.common import slices
from rankloom.session import materialise

# Characters of a part of a long text, and of the texts aligned together.
CHUNK = 32_768
BLOCK_CHARS = 1 << 18
BATCH_ROWS = 128
# Pairs of ids formed at a time.
BLOCK_PAIRS = 1 << 21
# Distinct pairs a task holds before it hands on what it has counted.
HELD_PAIRS = 1 << 20
# Pairs held by more than this part of all links outside the fast path are sent to the documents.
HOT_PAIRS = 1 << 16

RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

_CUT = re.compile(r"(?<=\w) (?=\w)")
_SPACE = "▁"
# Bytes of a token that stands for no text: they are in no UTF-8 text.
_NOTHING = b"\xff"

_loaded: dict[object, object] = {}


@dataclass(frozen=True)
class Files:
    """Tokenizer files that exist on every executor.

    ``a`` is a byte-level BPE, either as ``.json`` or as ranks with their ``pattern``; ``b`` a piece model.
    """

    a: str
    b: str
    pattern: str = ""


class Vocabulary:
    """Encoder, bytes of every id and their lengths."""

    def __init__(self, encode, token_bytes: Sequence[bytes]):
        self.encode = encode
        self.bytes = list(token_bytes)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        width = len(str(max(1, len(self.bytes) - 1)))
        # Decimal digits of every id, filled with zero bytes, and a place for what follows.
        digits = np.array([str(k) for k in range(len(self.bytes))], dtype=f"S{width + 1}")
        self.digits = digits.view(np.uint8).reshape(len(self.bytes), width + 1)


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as they are, the others as letters from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


def _json_vocabulary(path: str) -> Vocabulary:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    loaded.encode_special_tokens = True
    letters = _byte_of_letter()
    token_bytes = [_NOTHING] * loaded.get_vocab_size(True)
    for token, number in loaded.get_vocab(False).items():
        token_bytes[number] = bytes(letters[c] for c in token)
    return Vocabulary(
        lambda texts: [e.ids for e in loaded.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)],
        token_bytes,
    )


def _rank_vocabulary(path: str, pattern: str) -> Vocabulary:
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    token_bytes = [_NOTHING] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        token_bytes[rank] = token
    encoder = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return Vocabulary(lambda texts: [encoder.encode_ordinary(f" {t}") for t in texts], token_bytes)


def _piece_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    token_bytes = []
    for number in range(model.get_piece_size()):
        piece = model.id_to_piece(number)
        if model.is_byte(number):
            token_bytes.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(number) or model.is_unknown(number) or not piece:
            token_bytes.append(_NOTHING)
        else:
            token_bytes.append(piece.replace(_SPACE, " ").encode())
    found = Vocabulary(lambda texts: model.encode(list(texts), num_threads=1), token_bytes)
    found.byte_ids = {n for n in range(model.get_piece_size()) if model.is_byte(n)}
    return found


class Aligner:
    """Both vocabularies and the map from A ids to the B ids of the same bytes (-1 where there is none)."""

    def __init__(self, files: Files):
        self.a = _json_vocabulary(files.a) if files.a.endswith(".json") else _rank_vocabulary(files.a, files.pattern)
        self.b = _piece_vocabulary(files.b)
        # A written piece goes before a single byte of the same value.
        order = sorted(range(len(self.b.bytes)), key=lambda n: (n not in self.b.byte_ids, -n))
        named = {self.b.bytes[n]: n for n in order}
        named.pop(_NOTHING, None)
        self.same = np.array([named.get(token, -1) for token in self.a.bytes], np.int64)
        self.cuttable = not any(b" " in token.lstrip(b" ") for token in self.b.bytes)

    def parts(self, text: str, chunk: int) -> Iterator[str]:
        """The text in parts that are encoded as they are within the whole, each without the blank before it."""
        begin = 0
        while self.cuttable and len(text) - begin > chunk:
            found = _CUT.search(text, begin + chunk)
            if not found:
                break
            yield text[begin : found.start()]
            begin = found.end()
        yield text[begin:]


def aligner(files: Files) -> Aligner:
    """Loaded once per worker."""
    if files not in _loaded:
        _loaded[files] = Aligner(files)
    return _loaded[files]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


class Tally:
    """Sums by key. What comes in waits until there is as much of it as was summed before."""

    def __init__(self):
        self.keys = self.counts = np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(HELD_PAIRS, len(self.keys)):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order and the sums of their counts."""
        if self.waiting:
            self.keys, self.counts = _summed(
                np.concatenate([self.keys, *(k for k, _ in self.waiting)]),
                np.concatenate([self.counts, *(n for _, n in self.waiting)]),
            )
            self.waiting, self.size = [], 0
        return self.keys, self.counts


class Documents:
    """Alignment of some documents, gathered block by block."""

    def __init__(self, tools: Aligner, rows: int):
        self.tools = tools
        self.totals = np.zeros((4, rows), np.int64)  # A tokens, B tokens, groups, links
        self.sums = [None] * rows
        self.bad = np.zeros(rows, bool)
        self.pair_base = len(tools.a.bytes) * len(tools.b.bytes)
        self.same, self.pairs = Tally(), Tally()

    def add(self, owners: list[int], texts: list[str]) -> None:
        """Align the parts ``texts`` of the documents ``owners``."""
        a, b = self.tools.a, self.tools.b
        found_a, found_b = a.encode(texts), b.encode(texts)
        good = []
        for k, text in enumerate(texts):
            raw = f" {text}".encode("utf-8", "surrogatepass")
            if all(b"".join(map(v.bytes.__getitem__, ids[k])) == raw for v, ids in ((a, found_a), (b, found_b))):
                good.append(k)
            else:
                self.bad[owners[k]] = True
        if good:
            self._align(np.array([owners[k] for k in good]), [found_a[k] for k in good], [found_b[k] for k in good])

    def _align(self, owners: np.ndarray, found_a: list[list[int]], found_b: list[list[int]]) -> None:
        a_counts, b_counts = (np.array([len(ids) for ids in found], np.int64) for found in (found_a, found_b))
        a, b = (
            np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))
            for found, counts in ((found_a, a_counts), (found_b, b_counts))
        )
        a_end, b_end = np.cumsum(self.tools.a.lengths[a]), np.cumsum(self.tools.b.lengths[b])
        ends = np.zeros((2, int(a_end[-1]) + 1), bool)
        ends[0, a_end], ends[1, b_end] = True, True
        a_closes, b_closes = ends[1, a_end], ends[0, b_end]
        # The group of a token is the number of groups closed before it.
        a_group, b_group = np.cumsum(a_closes) - a_closes, np.cumsum(b_closes) - b_closes
        n_a, n_b = np.bincount(a_group), np.bincount(b_group)
        a_first, b_first = _starts(n_a), _starts(n_b)
        group_doc = np.repeat(owners, a_counts)[a_first]

        for total, amounts, docs in (
            (self.totals[0], a_counts, owners),
            (self.totals[1], b_counts, owners),
            (self.totals[2], np.ones(len(n_a), np.int64), group_doc),
            (self.totals[3], n_a * n_b, group_doc),
        ):
            np.add.at(total, docs, amounts)
        self._hash(owners, (a, a_counts, a_group, a_first, n_a, a_closes), (b, b_counts, b_group, b_first, b_closes))

        first_a, first_b = a[a_first], b[b_first]
        fast = (n_a == 1) & (n_b == 1) & (self.tools.same[first_a] == first_b)
        keys = group_doc[fast] * len(self.tools.a.bytes) + first_a[fast]
        self.same.add(keys, np.ones(len(keys), np.int64))
        if not fast.all():
            self._link_others(~fast, group_doc, (a, a_group), (b, b_group))

    def _hash(self, owners, a_side, b_side) -> None:
        """Feed the written groups to the check sums of their documents."""
        (a, a_counts, a_group, a_first, n_a, a_closes), (b, b_counts, b_group, b_first, b_closes) = a_side, b_side
        # An A token stands behind the B tokens of earlier groups, a B token behind its group's A tokens.
        a_place = np.arange(len(a)) + b_first[a_group]
        b_place = np.arange(len(b)) + (a_first + n_a)[b_group]
        width = max(self.tools.a.digits.shape[1], self.tools.b.digits.shape[1])
        written = np.zeros((len(a) + len(b), width), np.uint8)
        last = np.zeros(len(a), bool)
        last[a_first + n_a - 1] = True
        for digits, ids, place, marks in (
            (self.tools.a.digits, a, a_place, np.where(last, ord("|"), ord(","))),
            (self.tools.b.digits, b, b_place, np.where(b_closes, ord(";"), ord(","))),
        ):
            lines = np.zeros((len(ids), width), np.uint8)
            lines[:, : digits.shape[1]] = digits[ids]
            lines[:, -1] = marks
            written[place] = lines
        stops = np.cumsum(a_counts + b_counts)
        for doc, start, stop in zip(owners, stops - a_counts - b_counts, stops, strict=True):
            groups = written[start:stop].tobytes().translate(None, b"\0")[:-1]
            if self.sums[doc] is None:
                self.sums[doc] = sha256(groups)
            else:
                self.sums[doc].update(b";" + groups)

    def _link_others(self, others: np.ndarray, group_doc, a_side, b_side) -> None:
        """Pairs of ids in groups outside the fast path, with how often they are linked."""
        (a, a_group), (b, b_group) = a_side, b_side
        sides = []
        for ids, group, size in ((a, a_group, len(self.tools.a.bytes)), (b, b_group, len(self.tools.b.bytes))):
            here = others[group]
            keys, counts = _summed(group[here] * size + ids[here], np.ones(int(here.sum()), np.int64))
            sides.append((keys // size, keys % size, counts))
        (group, left, left_n), (b_of, right, right_n) = sides
        # Every id of A in a group meets the run of the group's B ids.
        first, stop = np.searchsorted(b_of, group), np.searchsorted(b_of, group, side="right")
        reach = np.cumsum(stop - first)
        begin = 0
        while begin < len(group):
            end = max(begin + 1, int(np.searchsorted(reach, (reach[begin - 1] if begin else 0) + BLOCK_PAIRS)))
            runs = (stop - first)[begin:end]
            row = np.repeat(np.arange(begin, begin + len(runs)), runs)
            at = np.repeat(first[begin:end] - _starts(runs), runs) + np.arange(int(runs.sum()))
            pair = left[row] * len(self.tools.b.bytes) + right[at]
            self._hold_pairs(group_doc[group[row]], pair, left_n[row] * right_n[at])
            begin = end

    def _hold_pairs(self, docs: np.ndarray, pairs: np.ndarray, counts: np.ndarray) -> None:
        size_b = len(self.tools.b.bytes)
        # Pairs of the same bytes belong to the vector, wherever they come from.
        known = self.tools.same[pairs // size_b] == pairs % size_b
        self.same.add(docs[known] * len(self.tools.a.bytes) + pairs[known] // size_b, counts[known])
        self.pairs.add(docs[~known] * self.pair_base + pairs[~known], counts[~known])

    def columns(self) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, groups_sha256, same, same_n, pair_a, pair_b and pair_n."""
        rows, good = len(self.bad), ~self.bad
        out = [pa.array(np.where(good, total, 0)) for total in self.totals]
        out.append(pa.array([s.hexdigest() if s and g else "" for s, g in zip(self.sums, good, strict=True)], pa.string()))
        for (keys, counts), base, split in (
            (self.same.settle(), len(self.tools.a.bytes), lambda k: [k]),
            (self.pairs.settle(), self.pair_base, lambda k: [k // len(self.tools.b.bytes), k % len(self.tools.b.bytes)]),
        ):
            kept = good[keys // base]
            keys, counts = keys[kept], counts[kept]
            offsets = pa.array(np.searchsorted(keys // base, np.arange(rows + 1)).astype(np.int32))
            for ids in split(keys % base):
                out.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))))
            out.append(pa.ListArray.from_arrays(offsets, pa.array(counts)))
        return out


_LINKED = (
    "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same array<int>, same_n array<long>, "
    "pair_a array<int>, pair_b array<int>, pair_n array<long>"
)


def link(docs: DataFrame, files: Files, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """row, key, n_a, n_b, n_groups, n_links, groups_sha256 and what is linked, one row per document.

    ``same`` are the A ids linked with the B id of the same bytes, ``pair_a`` and ``pair_b`` all other
    linked ids, each distinct, with their numbers of links. ``row`` tells rows apart; write the result
    before it is read twice.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")
    )
    names = ["row", "key"]
    schema = T.StructType([rows.schema[n] for n in names] + T.StructType.fromDDL(_LINKED).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = aligner(files)
        for batch in slices(batches, BATCH_ROWS):
            found = Documents(tools, batch.num_rows)
            owners, parts, size = [], [], 0
            for owner, value in enumerate(batch.column("text")):
                body = value.as_py()
                for part in tools.parts(body, chunk) if body else ():
                    owners.append(owner)
                    parts.append(part)
                    size += len(part)
                    if size >= BLOCK_CHARS:
                        found.add(owners, parts)
                        owners, parts, size = [], [], 0
            if parts:
                found.add(owners, parts)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *found.columns()], names=schema.names)

    return rows.mapInArrow(run, schema)


def count_links(linked: DataFrame, vocabulary_a: int, vocabulary_b: int) -> DataFrame:
    """a, b and n, some rows for every pair; b is null where it is the id of the same bytes.

    Each task adds up a vector for those and the other pairs it holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, held = np.zeros(vocabulary_a, np.int64), Tally()
        for batch in batches:
            vector += np.bincount(_flat(batch, "same"), minlength=vocabulary_a)
            pairs = _flat(batch, "pair_a") * vocabulary_b + _flat(batch, "pair_b")
            held.add(pairs, np.ones(len(pairs), np.int64))
            if len(held.keys) >= HELD_PAIRS:
                yield _counts(*np.divmod(held.settle()[0], vocabulary_b), held.counts)
                held = Tally()
        yield _counts(*np.divmod(held.settle()[0], vocabulary_b), held.counts)
        used = np.flatnonzero(vector)
        yield _counts(used, None, vector[used])

    return linked.select("same", "pair_a", "pair_b").mapInArrow(run, "a int, b int, n long")


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _counts(a: np.ndarray, b: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
    right = pa.nulls(len(a), pa.int32()) if b is None else pa.array(b.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), right, pa.array(n)], names=["a", "b", "n"])


@dataclass
class Counts:
    """Documents per pair: vectors by A id for the ids of the same bytes and for the highest count, hot
    pairs in order, and the table (a, b, n, top) of all pairs outside the fast path."""

    same: np.ndarray
    best: np.ndarray
    hot: np.ndarray
    hot_n: np.ndarray
    limit: int
    pairs: DataFrame


def corpus_counts(linked: DataFrame, vocabulary_a: int, vocabulary_b: int) -> Counts:
    """Counts over all documents of ``linked``, which has been written before."""
    spark = linked.sparkSession
    parts = materialise(count_links(linked, vocabulary_a, vocabulary_b), "token-links")
    pairs = materialise(parts.where("b IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("n")), "token-pairs")
    # Two vectors of one number per A id.
    same, best = np.zeros(vocabulary_a, np.int64), np.zeros(vocabulary_a, np.int64)
    for r in parts.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n")).toLocalIterator():
        same[r["a"]] = r["n"]
    for r in pairs.groupBy("a").agg(F.max("n").alias("n")).toLocalIterator():
        best[r["a"]] = r["n"]
    best = np.maximum(best, same)
    limit = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // HOT_PAIRS
    # Fewer than HOT_PAIRS pairs can each have more than this part of the sum.
    hot = sorted((r["a"] * vocabulary_b + r["b"], r["n"]) for r in pairs.where(F.col("n") > limit).toLocalIterator())
    tops = spark.createDataFrame([(a, int(n)) for a, n in enumerate(best) if n], "a int, best long")
    pairs = pairs.join(F.broadcast(tops), "a").select("a", "b", "n", (F.col("n") == F.col("best")).alias("top"))
    return Counts(same, best, np.array([k for k, _ in hot], np.int64), np.array([n for _, n in hot], np.int64), limit, pairs)


_SCORED = "n_best long, count_sum long, rare_a array<int>, rare_b array<int>, rare_n array<long>"


def _score_known(linked: DataFrame, counts: Counts, vocabulary_b: int) -> DataFrame:
    """Sums over the links whose counts are sent along; the rest of the pairs is left in the row."""
    names = ["row", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = T.StructType([linked.schema[n] for n in names] + T.StructType.fromDDL(_SCORED).fields)
    known = (counts.same, counts.best, counts.hot, counts.hot_n)
    shared = linked.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, best, hot, hot_n = shared.value
        for batch in slices(batches):
            rows = np.arange(batch.num_rows)
            n_best, count_sum = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)

            def take(owner, a, times, count):
                np.add.at(count_sum, owner, times * count)
                np.add.at(n_best, owner, np.where(count == best[a], times, 0))

            a, times = _flat(batch, "same"), _flat(batch, "same_n")
            take(np.repeat(rows, batch.column("same").value_lengths().to_numpy()), a, times, same[a])
            a, b, times = (_flat(batch, n) for n in ("pair_a", "pair_b", "pair_n"))
            owner = np.repeat(rows, batch.column("pair_a").value_lengths().to_numpy())
            pair = a * vocabulary_b + b
            at = np.minimum(np.searchsorted(hot, pair), max(0, len(hot) - 1))
            sent = hot[at] == pair if len(hot) else np.zeros(len(pair), bool)
            take(owner[sent], a[sent], times[sent], hot_n[at[sent]] if len(hot) else times[sent])
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner[~sent], minlength=len(rows))))).astype(np.int32))
            rare = [pa.ListArray.from_arrays(offsets, pa.array(x[~sent].astype(t))) for x, t in ((a, np.int32), (b, np.int32), (times, np.int64))]
            columns = [*(batch.column(n) for n in names), pa.array(n_best), pa.array(count_sum), *rare]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return linked.mapInArrow(run, schema)


def align(docs: DataFrame, files: Files, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, one row per document."""
    tools = aligner(files)
    size_a, size_b = len(tools.a.bytes), len(tools.b.bytes)
    linked = materialise(link(docs, files, key, text, chunk), "token-alignment")
    counts = corpus_counts(linked, size_a, size_b)
    scored = materialise(_score_known(linked, counts, size_b), "token-scores")
    rare = scored.select("row", F.inline(F.arrays_zip("rare_a", "rare_b", "rare_n"))).toDF("row", "a", "b", "times")
    added = (
        rare.join(counts.pairs.where(F.col("n") <= counts.limit), ["a", "b"])
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("times") * F.col("n")).alias("more_sum"),
        )
    )
    return scored.join(added, "row", "left").select(
        F.col("key").alias(key),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
