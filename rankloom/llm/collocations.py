"""Phrases whose words stand together more often than their parts let expect.

Texts are cut into pieces at punctuation and line ends, pieces into words. Phrases of two to four words are
counted by vertical partitioning of the suffixes of all pieces, cut off at depth four:

1. Words are counted. Only those that are frequent enough can be part of a phrase.
2. Prefixes of two such words are counted, and those that are frequent enough are put in groups, in the
   order of a hash, so that the suffixes below the prefixes of a group stay within a budget. The borders of
   the groups, a bounded list of numbers, go to all tasks. A prefix above the budget is extended: its
   suffixes are dealt over several parts by the words that follow.
3. Every suffix of three or four words below a prefix goes to its group, added up per task before. Each
   group builds its subtrees on its own, as the sorted list of their leaves, and reads the counts of all
   nodes from leaf totals.

Bloom filters of frequent words and prefixes, of bounded size, cut suffixes short where nothing frequent can
follow; what they let pass in error falls under the count. A phrase is scored by its weakest cut, and left
out if a longer frequent phrase around it has nearly its count. Scores are compared within a language.

Words travel as 64-bit hashes of language and word. A second hash tells whether two words share one and one
of them might be frequent; then everything starts again with other hashes, so counts are exact.

Defined results: null and empty texts have no words; a null language is ``und``, like that name itself.
Rows are counted as they come, repeated or not. Equal scores go to the larger count, then to the smaller
phrase by its UTF-8 bytes. Very long texts are read whole, cut at piece ends ``BLOCK_BYTES`` apart. An
empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce
from hashlib import blake2b
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rankloom.llm.common import text_bytes
from rankloom.operators.joins import heavy_keys, salted_join
from rankloom.session import materialise

DEPTH = 4
KEYS = tuple(f"k{place}" for place in range(1, DEPTH + 1))
UNKNOWN = "und"
BLOCK_BYTES = 1 << 20
# Rows a task holds before it hands on what it has added up.
HELD_ROWS = 1 << 19
# Different words it holds; each takes some hundred bytes.
HELD_WORDS = 1 << 18
# Suffixes of a group; more where there would be more than MAX_GROUPS groups otherwise.
BUDGET = 1 << 20
MAX_GROUPS = 1 << 20
# Bits of a filter: 16 for every key, but never more than this. 2^25 bits are 4 MB.
FILTER_BITS = 25
# A language's phrases are ranked in shares first: so many in the last step but one, and in the first as many more
# as it takes for about SHARE_ROWS phrases in each.
SLICES = 64
SHARE_ROWS = 1 << 18

RESULTS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")

_SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
_BLANKS = b"\x20\x09"
_SEPARATOR = re.compile(rb"[.,;:!?\x0a-\x0d]")
_FACTORS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHIFTS = (0, 19, 38)


@dataclass(frozen=True)
class Settings:
    min_count: int = 30
    # Phrases kept per language.
    keep: int = 2000
    # A phrase goes if a longer one has at least this many hundredths of its count.
    covered: int = 80
    scale: int = 2_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _FACTORS[0]
    x = (x ^ (x >> np.uint64(27))) * _FACTORS[1]
    return x ^ (x >> np.uint64(31))


def _joined(*keys: np.ndarray) -> np.ndarray:
    """One hash of several, as signed numbers."""
    total = np.full(len(keys[0]), len(keys), np.uint64)
    for key in keys:
        total = _mixed(total * _STEP + key.view(np.uint64))
    return total.view(np.int64)


class Hashes:
    """A family of hashes of byte strings: polynomials over random numbers for bytes, modulo 2^64."""

    def __init__(self, seed: int):
        self.seed = seed
        random = np.random.Generator(np.random.PCG64(seed))
        self.letters = random.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(random.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            size = max(size, 2 * len(self.powers))
            for name, base in (("powers", self.base), ("inverse", pow(self.base, -1, 2**64))):
                factors = np.full(size, base % 2**64, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors))

    def words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges, each with its language's number."""
        self._grow(len(raw) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.letters[raw] * self.powers[: len(raw)])))
        own = (sums[ends] - sums[starts]) * self.inverse[starts]
        return _joined(own, (ends - starts).astype(np.int64), langs)

    def name(self, lang: str) -> int:
        digest = blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8, salt=self.seed.to_bytes(8, "little")).digest()
        return int.from_bytes(digest, "little", signed=True)


@cache
def _hashes(seed: int) -> Hashes:
    """Made once per worker."""
    return Hashes(seed)


@cache
def _kinds() -> np.ndarray:
    """0 for bytes of words, 1 for blanks, 2 for the ends of pieces."""
    kinds = np.zeros(256, np.uint8)
    kinds[np.frombuffer(_BLANKS, np.uint8)] = 1
    kinds[np.frombuffer(_SEPARATORS, np.uint8)] = 2
    return kinds


@dataclass
class Block:
    """Words of some texts: byte ranges, number of the text, and whether the next word is in the same piece."""

    raw: bytes
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    followed: np.ndarray
    langs: list[str]

    def hashes(self, seed: int) -> np.ndarray:
        family = _hashes(seed)
        names = np.array([family.name(lang) for lang in self.langs], np.int64)
        return family.words(np.frombuffer(self.raw, np.uint8), self.starts, self.ends, names[self.owner])


def _parts(raw: bytes, size: int) -> Iterator[bytes]:
    """A text in parts that end where a piece ends."""
    begin = 0
    while len(raw) - begin > size:
        found = _SEPARATOR.search(raw, begin + size)
        if not found:
            break
        yield raw[begin : found.start()]
        begin = found.end()
    yield raw[begin:]


def _block(texts: list[bytes], langs: list[str]) -> Block:
    raw = b"\n".join(texts).lower()  # A-Z only
    kinds = _kinds()[np.frombuffer(raw, np.uint8)]
    word = np.concatenate(([False], kinds == 0, [False]))
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    piece = np.concatenate(([0], np.cumsum(kinds == 2)))[starts]
    followed = np.concatenate((piece[1:] == piece[:-1], [False]))[: len(starts)]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return Block(raw, starts, ends, np.searchsorted(begins, starts, side="right") - 1, followed, langs)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    texts, langs, size = [], [], 0
    for batch in batches:
        for lang, raw in zip(batch.column("lang"), batch.column("raw"), strict=True):
            name = lang.as_py()
            for part in _parts(raw.as_py(), BLOCK_BYTES):
                texts.append(part)
                langs.append(name)
                size += len(part)
                if size >= BLOCK_BYTES:
                    yield _block(texts, langs)
                    texts, langs, size = [], [], 0
    if texts:
        yield _block(texts, langs)


class Sums:
    """Counts of keys made of several numbers, held until there are too many."""

    def __init__(self, width: int):
        self.width = width
        self.held: list[np.ndarray] = []
        self.size = 0
        self.limit = HELD_ROWS

    def add(self, keys: list[np.ndarray], counts: np.ndarray | None = None) -> np.ndarray | None:
        """Take in rows; rows added up, if it is time to hand them on."""
        counts = np.ones(len(keys[0]), np.int64) if counts is None else counts
        self.held.append(np.stack([*keys, counts]))
        self.size += len(counts)
        if self.size < self.limit:
            return None
        self.held = [self._added()]
        self.size = self.held[0].shape[1]
        # Where adding up saves little, there is no use in holding on.
        if self.size > HELD_ROWS // 2:
            return self.rest()
        self.limit = self.size + HELD_ROWS
        return None

    def _added(self) -> np.ndarray:
        rows = np.concatenate(self.held, axis=1) if self.held else np.zeros((self.width + 1, 0), np.int64)
        if not rows.shape[1]:
            return rows
        # Equal keys meet by one hash; should others share it, a key may come in several rows.
        rows = rows[:, np.argsort(_joined(*rows[: self.width]), kind="stable")]
        fresh = (rows[: self.width, 1:] != rows[: self.width, :-1]).any(axis=0)
        starts = np.flatnonzero(np.concatenate(([True], fresh)))
        return np.vstack((rows[: self.width, starts], np.add.reduceat(rows[self.width], starts)[None]))

    def rest(self) -> np.ndarray:
        rows = self._added()
        self.held, self.size, self.limit = [], 0, HELD_ROWS
        return rows


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), text_bytes(F.col(f"`{text}`")).alias("raw")
    ).where(F.octet_length("raw") > 0)


def _word_rows(texts: DataFrame, seed: int) -> DataFrame:
    """k1, lang, word, n and the range of a second hash; with null k1 and word, all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}
        held: dict[int, list] = {}
        for block in _blocks(batches):
            keys, checks = block.hashes(seed), block.hashes(seed + 1)
            owners, times = np.unique(block.owner, return_counts=True)
            for owner, n in zip(owners, times, strict=True):
                name = block.langs[owner]
                totals[name] = totals.get(name, 0) + int(n)
            order = np.argsort(keys, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) != 0))) if len(order) else order
            if not len(starts):
                continue
            low, high = (f.reduceat(checks[order], starts) for f in (np.minimum, np.maximum))
            n = np.diff(np.concatenate((starts, [len(order)])))
            first = order[starts]
            for key, at, times, least, most in zip(
                keys[first].tolist(), first.tolist(), n.tolist(), low.tolist(), high.tolist(), strict=True
            ):
                known = held.get(key)
                if known is None:
                    word = block.raw[block.starts[at] : block.ends[at]]
                    held[key] = [block.langs[block.owner[at]], word, times, least, most]
                else:
                    known[2] += times
                    known[3], known[4] = min(known[3], least), max(known[4], most)
            if len(held) >= HELD_WORDS:
                yield packed(held)
                held = {}
        yield packed(held)
        nothing = pa.nulls(len(totals), pa.int64())
        columns = [nothing, pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.binary())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(totals.values()), pa.int64()), nothing, nothing], names=names)

    names = ["k1", "lang", "word", "n", "low", "high"]

    def packed(held: dict[int, list]) -> pa.RecordBatch:
        rows = list(held.values())
        kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), *columns], names=names)

    return texts.mapInArrow(run, "k1 long, lang string, word binary, n long, low long, high long")


def count_words(texts: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame, int]:
    """Frequent words (k1, lang, word, n), all words per language (lang, n), and the seed of their hashes."""
    for seed in count(1, 2):
        rows = materialise(_word_rows(texts, seed), "phrase-words")
        # Tasks have added up what they can; a second try before the shuffle would only take memory.
        words = rows.where("k1 IS NOT NULL").repartition("k1").groupBy("k1").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
        )
        words = materialise(words.where(F.col("n") >= min_count), "phrase-frequent-words")
        if words.where("low <> high").limit(1).count():
            continue  # two words share a hash
        # One of the texts a hash came with; they are all the same.
        named = rows.join(words.select("k1"), "k1", "left_semi").select("k1", "lang", "word").dropDuplicates(["k1"])
        words = materialise(words.select("k1", "n").join(named, "k1"), "phrase-word-names")
        totals = rows.where("k1 IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
        return words, totals, seed
    raise AssertionError


@dataclass(frozen=True)
class Filter:
    """A Bloom filter of well mixed hashes; empty if it was given no keys."""

    bits: int
    words: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        every = np.ones(len(keys), bool)
        for shift in _SHIFTS:
            place = (keys.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)
            every &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return every


def build_filter(keys: DataFrame, key: str, number: int) -> Filter:
    """The filter of a column; at most 2^FILTER_BITS bits come to the driver."""
    bits = min(FILTER_BITS, max(10, (16 * number - 1).bit_length()))
    mask = F.lit((1 << bits) - 1).cast("long")
    places = F.array(*[F.shiftrightunsigned(F.col(key), shift).bitwiseAND(mask) for shift in _SHIFTS])
    found = (
        keys.select(F.explode(places).alias("place"))
        .groupBy(F.shiftright("place", 6).cast("int").alias("at"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))).alias("w"))
        .toArrow()
    )
    words = np.zeros(1 << max(0, bits - 6), np.uint64)
    words[found.column("at").to_numpy()] = found.column("w").to_numpy().view(np.uint64)
    return Filter(bits, words)


def _packed(rows: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row) for row in rows], names=names)


def count_prefixes(texts: DataFrame, words: Filter, seed: int, min_count: int) -> DataFrame:
    """k1, k2 and n of all prefixes of two words that are frequent enough."""
    shared = texts.sparkSession.sparkContext.broadcast(words)
    names = ["k1", "k2", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kept = Sums(2), shared.value
        for block in _blocks(batches):
            keys = block.hashes(seed)
            known = kept.has(keys)
            at = np.flatnonzero(block.followed & known & np.append(known[1:], False))
            done = sums.add([keys[at], keys[at + 1]])
            if done is not None:
                yield _packed(done, names)
        yield _packed(sums.rest(), names)

    # Added up per task already.
    rows = texts.mapInArrow(run, "k1 long, k2 long, n long").repartition("k1", "k2")
    return rows.groupBy("k1", "k2").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _with_order(prefixes: DataFrame) -> DataFrame:
    """Prefixes with ``order``, the hash they are grouped by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy() for k in ("k1", "k2"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_joined(k1, k2))], names=[*batch.schema.names, "order"])

    return prefixes.mapInArrow(run, "k1 long, k2 long, n long, order long")


@dataclass(frozen=True)
class Groups:
    """Least hash of every group but the first, and the prefixes above the budget with their parts."""

    borders: np.ndarray
    large: np.ndarray
    parts: np.ndarray

    def of(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group, and the number of parts of the prefix."""
        at = np.searchsorted(self.large, order)
        own = np.ones(len(order), np.int64)
        if len(self.large):
            at = np.minimum(at, len(self.large) - 1)
            own = np.where(self.large[at] == order, self.parts[at], 1)
        return np.searchsorted(self.borders, order, side="right"), own


def group_prefixes(prefixes: DataFrame, budget: int, max_groups: int) -> Groups:
    """Runs of prefixes, in the order of their hash, with about ``budget`` suffixes each.

    ``prefixes`` has been written before. Prefix sums are formed within buckets of the hash; the buckets'
    own sums are few.
    """
    total = prefixes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    budget = max(budget, -(-total // max_groups))
    buckets = prefixes.withColumn("bucket", F.shiftright("order", 52))  # 4096 of them
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = buckets.groupBy("bucket").agg(F.sum("n").alias("n")).select(
        "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin")
    )
    within = Window.partitionBy("bucket").orderBy("order", "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(begins), "bucket")
    group = F.floor((F.col("begin") + F.col("before")) / F.lit(budget))
    # At most two more numbers than there are groups.
    borders = placed.groupBy(group.alias("g")).agg(F.min("order").alias("order")).select("order").toArrow()
    large = prefixes.where(F.col("n") > budget).groupBy("order").agg(F.ceil(F.sum("n") / budget).alias("parts")).orderBy("order").toArrow()
    return Groups(
        np.sort(borders.column("order").to_numpy())[1:],
        large.column("order").to_numpy().astype(np.int64),
        large.column("parts").to_numpy().astype(np.int64),
    )


def suffixes(texts: DataFrame, words: Filter, prefixes: Filter, groups: Groups, seed: int) -> DataFrame:
    """group, part, parts, k1 to k4, depth and n: suffixes of three words, or of four where k4 may follow."""
    shared = texts.sparkSession.sparkContext.broadcast((words, prefixes, groups))
    names = ["group", "part", "parts", *KEYS, "depth", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_filter, prefix_filter, borders = shared.value
        sums = Sums(DEPTH + 1)

        def dealt(rows: np.ndarray) -> pa.RecordBatch:
            group, parts = borders.of(_joined(rows[0], rows[1]))
            part = (_joined(rows[2], rows[3]).view(np.uint64) % parts.view(np.uint64)).astype(np.int64)
            return _packed(np.vstack((group, part, parts, rows)), names)

        for block in _blocks(batches):
            keys = block.hashes(seed)
            known = word_filter.has(keys)
            step = block.followed & known & np.append(known[1:], False)
            at = np.flatnonzero(step)
            step[at] = prefix_filter.has(_joined(keys[at], keys[at + 1]))
            step = np.append(step, [False, False])
            at = np.flatnonzero(step[:-2] & step[1:-1])
            deep = step[at + 2]
            last = np.where(deep, keys[np.minimum(at + 3, len(keys) - 1)] if len(keys) else at, 0)
            done = sums.add([keys[at], keys[at + 1], keys[at + 2], last, np.where(deep, 4, 3)])
            if done is not None:
                yield dealt(done)
        yield dealt(sums.rest())

    return texts.mapInArrow(run, ", ".join(f"`{n}` long" for n in names))


def build_subtrees(rows: DataFrame, min_count: int) -> DataFrame:
    """size, k1 to k4 and n of the nodes of three and four words; k4 is 0 for three."""

    def run(table: pa.Table) -> pa.Table:
        keys = [table.column(k).to_numpy() for k in KEYS]
        depth, n, parts = (table.column(c).to_numpy() for c in ("depth", "n", "parts"))
        # In this order the leaves below any node are neighbours.
        order = np.lexsort((depth, *reversed(keys)))
        keys, depth, n, parts = [k[order] for k in keys], depth[order], n[order], parts[order]

        def totals(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            fresh = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
            starts = np.flatnonzero(np.concatenate(([True], fresh)))
            return starts, np.add.reduceat(n, starts)

        inner, inner_n = totals(keys[:3])
        leaf, leaf_n = totals([*keys, depth])
        # A prefix in parts has some of a node's leaves here; its sums are added up later.
        inner_kept = (inner_n >= min_count) | (parts[inner] > 1)
        leaf_kept = (leaf_n >= min_count) & (depth[leaf] == DEPTH)
        inner, inner_n, leaf, leaf_n = inner[inner_kept], inner_n[inner_kept], leaf[leaf_kept], leaf_n[leaf_kept]
        columns = {"size": np.concatenate((np.full(len(inner), 3), np.full(len(leaf), 4))).astype(np.int32)}
        for place, key in enumerate(keys):
            upper = key[inner] if place < 3 else np.zeros(len(inner), np.int64)
            columns[KEYS[place]] = np.concatenate((upper, key[leaf]))
        return pa.table(columns | {"n": np.concatenate((inner_n, leaf_n))})

    schema = "size int, " + ", ".join(f"{k} long" for k in KEYS) + ", n long"
    nodes = rows.groupBy("group", "part").applyInArrow(run, schema)
    return nodes.groupBy("size", *KEYS).agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def count_phrases(docs: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang"):
    """All frequent phrases of one to four words (size, k1 to k4, n; unused keys are 0), the words behind the
    keys (k1, lang, word, n) and the words per language (lang, n)."""
    texts = _texts(docs, text, lang)
    words, totals, seed = count_words(texts, settings.min_count)
    word_filter = build_filter(words, "k1", words.count())
    prefixes = materialise(_with_order(count_prefixes(texts, word_filter, seed, settings.min_count)), "phrase-prefixes")
    groups = group_prefixes(prefixes, BUDGET, MAX_GROUPS)
    prefix_filter = build_filter(prefixes, "order", prefixes.count())
    nodes = build_subtrees(suffixes(texts, word_filter, prefix_filter, groups, seed), settings.min_count)
    none = F.lit(0).cast("long")
    ones = words.select(F.lit(1).alias("size"), "k1", *[none.alias(k) for k in KEYS[1:]], "n")
    twos = prefixes.select(F.lit(2).alias("size"), "k1", "k2", *[none.alias(k) for k in KEYS[2:]], "n")
    phrases = materialise(ones.unionByName(twos).unionByName(nodes), "phrase-counts")
    return phrases, words, totals


def _part(first: int, size: int) -> list[Column]:
    """Size and keys of the words ``first`` to ``first + size`` of a row, as columns of their own."""
    keys = [F.col(KEYS[first + k]) if k < size else F.lit(0).cast("long") for k in range(DEPTH)]
    return [F.lit(size).alias("size"), *[key.alias(name) for key, name in zip(keys, KEYS, strict=True)]]


def score_phrases(phrases: DataFrame, settings: Settings) -> DataFrame:
    """size, k1 to k4, a, l, r and score of the phrases of two words or more that are not covered."""
    whole = ["size", *KEYS]
    candidates = phrases.where("size > 1").withColumnRenamed("n", "a")
    own = F.struct(*whole, "a").alias("phrase")
    asked = None
    for size in range(2, DEPTH + 1):
        parts = F.array(
            *[
                F.struct(F.lit(cut).alias("cut"), F.lit(side).alias("side"), *_part(first, length))
                for cut in range(1, size)
                for side, first, length in (("l", 0, cut), ("r", cut, size - cut))
            ]
        )
        rows = candidates.where(F.col("size") == size).select(own, F.inline(parts))
        asked = rows if asked is None else asked.unionByName(rows)
    # A word may begin or end very many phrases.
    heavy = heavy_keys(asked.groupBy(*whole).agg(F.count(F.lit(1)).alias("rows")), whole, "rows")
    cuts = (
        salted_join(asked, phrases, whole, heavy, F.struct("phrase", "cut"))
        .groupBy("phrase", "cut")
        .agg(F.max(F.when(F.col("side") == "l", F.col("n"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("n"))).alias("r"))
        .withColumn(
            "score",
            F.expr(f"CAST(CAST(phrase.a AS DECIMAL(20, 0)) * {settings.scale} DIV (CAST(l AS DECIMAL(20, 0)) + r) AS BIGINT)"),
        )
        .groupBy("phrase")
        .agg(F.min(F.struct("score", "cut", "l", "r")).alias("weakest"))
        .select("phrase.*", "weakest.l", "weakest.r", "weakest.score")
    )
    inside = None
    for size in range(3, DEPTH + 1):
        parts = F.array(*[F.struct(*_part(first, length)) for length in range(2, size) for first in range(size - length + 1)])
        rows = candidates.where(F.col("size") == size).select(F.col("a").alias("around"), F.inline(parts))
        inside = rows if inside is None else inside.unionByName(rows)
    around = inside.groupBy(*whole).agg(F.max("around").alias("around"))
    hundred = F.lit(100).cast("decimal(5,0)")
    covers = F.col("around").cast("decimal(20,0)") * hundred >= F.col("a").cast("decimal(20,0)") * F.lit(settings.covered).cast("decimal(5,0)")
    return cuts.join(around, whole, "left").where(~F.coalesce(covers, F.lit(False))).drop("around")


def mine(docs: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the first ``keep`` phrases of every language.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the two parts of its weakest cut, ``n`` the number
    of words in the language.
    """
    phrases, words, totals = count_phrases(docs, settings, text, lang)
    scored = materialise(score_phrases(phrases, settings), "phrase-scores")
    heavy = heavy_keys(scored.groupBy("k1").agg(F.count(F.lit(1)).alias("rows")), ["k1"], "rows")
    told = salted_join(scored, words.select("k1", "lang"), ["k1"], heavy, F.struct(*KEYS))
    # Shares of a language keep what may be among its first, ties included, in steps; then texts are needed.
    shares = SLICES * max(1, -(-scored.count() // (SLICES * SHARE_ROWS)))
    leading = told.withColumn("share", F.pmod(F.xxhash64(*KEYS), F.lit(shares)))
    for group in (["lang", "share"], ["lang", F.pmod("share", F.lit(SLICES))], ["lang"]):
        best = Window.partitionBy(*group).orderBy(F.desc("score"), F.desc("a"))
        leading = leading.withColumn("rank", F.rank().over(best)).where(F.col("rank") <= settings.keep)
    leading = materialise(leading.drop("rank"), "phrase-leading")
    named = leading.select(
        "lang", "share", "a", "l", "r", "score", F.xxhash64(*KEYS).alias("id"), "k1", "k2", "k3", "k4", "size",
        F.posexplode(F.slice(F.array(*KEYS), F.lit(1), F.col("size"))).alias("place", "key"),
    )
    texts = words.select(F.col("k1").alias("key"), "word")
    heavy = heavy_keys(named.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), ["key"], "rows")
    spelt = (
        salted_join(named, texts, ["key"], heavy, F.col("id"))
        .groupBy("lang", "share", "a", "l", "r", "score", "size", *KEYS)
        .agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("words"))
        .select("lang", "share", "a", "l", "r", "score", F.array_join(F.transform("words", lambda w: w["word"].cast("string")), " ").alias("phrase"))
    )
    # Ties with the last place may be many; they are told apart in shares as well.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for group in (["lang", "share"], ["lang"]):
        ranked = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        spelt = spelt.withColumn("rank", ranked.cast("long")).where(F.col("rank") <= settings.keep)
    return spelt.join(totals, "lang").select(*RESULTS)
