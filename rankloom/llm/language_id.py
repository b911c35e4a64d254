"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point and a seed. An n-gram of three
letters is bound into one vector: the product of its letters' vectors, each permuted (rolled) by its
place in the n-gram. A document bundles its n-grams: the sum of their vectors. A language's prototype is
the sum of its documents' bundles, each scaled to unit length, so long documents do not drown the rest.
A document gets the language whose prototype has the largest cosine with its bundle.

Letters are lower-cased; everything between letters counts as one blank, and so do the ends of a text.
Learning reads all rows it is given: each task bundles its documents, and the sums, held as integers, do
not depend on the order of addition. Prototypes come to the driver in slices of ``LANGS_PER_PASS``
languages and the documents are compared with one slice per pass, so many languages do no harm.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every text when
nothing was learned. Cosines of either sign are compared; the score is the largest, or 0 if it is negative.
Equal cosines go to the smaller language name. Rows without language are not learned from. A very long text
is read whole, its n-grams counted a block of characters at a time. Repeated rows each get their row; an
empty table gives an empty table. Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rankloom.llm.common import free_name, slices, without

DIM = 1024
GRAM = 3
SEED = 7
UNKNOWN = "und"
# 256 prototypes of 1024 doubles are 2 MB.
LANGS_PER_PASS = 256
# Documents whose n-grams are bundled by one matrix product.
BLOCK_TEXTS = 64
# N-grams bound at a time: 4096 vectors of 1024 single-precision numbers are 16 MB.
BLOCK_GRAMS = 4096
# Letters with a vector in memory; a worker forgets them all when there are more.
MAX_LETTERS = 20_000

_SCALE = 1e9
# Less than any cosine.
_BELOW = -2.0
_CODE_BITS = 21
_BLANK = ord(" ")
# Characters whose n-grams are formed at a time.
BLOCK_CHARS = 1 << 16

RESULTS = ("lang_pred", "score")


class Letters:
    """Random vectors of letters, made on demand and the same in every worker."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self.known: dict[int, np.ndarray] = {}

    def vector(self, code: int) -> np.ndarray:
        if code not in self.known:
            if len(self.known) >= MAX_LETTERS:
                self.known.clear()
            bits = np.random.Generator(np.random.PCG64([self.seed, code])).integers(0, 2, self.dim, dtype=np.int8)
            self.known[code] = 2 * bits - 1
        return self.known[code]

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """One row of +1 and -1 per n-gram code."""
        bound = None
        for place in range(GRAM):
            codes = (grams >> (_CODE_BITS * (GRAM - 1 - place))) & ((1 << _CODE_BITS) - 1)
            distinct, where = np.unique(codes, return_inverse=True)
            rolled = np.stack([np.roll(self.vector(int(c)), GRAM - 1 - place) for c in distinct])
            bound = rolled[where] if bound is None else bound * rolled[where]
        return bound.astype(np.float32)


@cache
def _is_letter() -> np.ndarray:
    """For every code point, whether it is a letter: one byte each, made once per worker."""
    return np.fromiter((chr(code).isalpha() for code in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _letters_and_blanks(text: str) -> Iterator[np.ndarray]:
    """The lower-cased letters of a text as code points, one blank for all that lies between two, and
    one at either end; a block of the text at a time. Nothing if there is no letter."""
    lowered, after_letter, begun = text.lower(), False, False
    for start in range(0, len(lowered), BLOCK_CHARS):
        raw = lowered[start : start + BLOCK_CHARS].encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(raw, dtype=np.uint32)
        letter = _is_letter()[codes]
        # The first of the characters that follow a letter stands for the blank.
        kept = letter | np.concatenate(([after_letter], letter[:-1]))
        codes = np.where(letter, codes, _BLANK)[kept].astype(np.int64)
        after_letter = bool(letter[-1])
        if len(codes):
            yield codes if begun else np.concatenate(([_BLANK], codes))
            begun = True
    if after_letter:
        yield np.array([_BLANK], np.int64)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a text and how often each occurs; empty without a letter."""
    found, carried = [], np.zeros(0, np.int64)
    for codes in _letters_and_blanks(text or ""):
        codes = np.concatenate((carried, codes))
        joined = np.zeros(max(0, len(codes) - GRAM + 1), np.int64)
        for place in range(GRAM):
            joined = (joined << _CODE_BITS) | codes[place : len(joined) + place]
        found.append(np.unique(joined, return_counts=True))
        carried = codes[len(joined) :]
    if len(found) < 2:
        return found[0] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    distinct, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    counts = np.zeros(len(distinct), np.int64)
    np.add.at(counts, where, np.concatenate([n for _, n in found]))
    return distinct, counts


def bundle(texts: Sequence[str | None], letters: Letters) -> np.ndarray:
    """Unit bundles, one row per text; a row of zeros where there is no letter."""
    out = np.zeros((len(texts), letters.dim), np.float32)
    for first in range(0, len(texts), BLOCK_TEXTS):
        part = [grams(text) for text in texts[first : first + BLOCK_TEXTS]]
        codes = np.concatenate([c for c, _ in part])
        if not len(codes):
            continue
        counts = np.concatenate([n for _, n in part]).astype(np.float32)
        rows = np.repeat(np.arange(len(part)), [len(c) for c, _ in part])
        distinct, where = np.unique(codes, return_inverse=True)
        for start in range(0, len(distinct), BLOCK_GRAMS):
            stop = min(start + BLOCK_GRAMS, len(distinct))
            here = (where >= start) & (where < stop)
            table = np.zeros((len(part), stop - start), np.float32)
            table[rows[here], where[here] - start] = counts[here]
            out[first : first + len(part)] += table @ letters.bind(distinct[start:stop])
    norm = np.linalg.norm(out.astype(np.float64), axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float64)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM, seed: int = SEED) -> DataFrame:
    """Prototypes: lang, place and value, ``dim`` rows for each language that has documents."""
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(dim, seed)
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            names = np.array(batch.column("lang").to_pylist(), dtype=object)
            scaled = np.rint(bundle(batch.column("text").to_pylist(), letters) * _SCALE).astype(np.int64)
            for name in set(names):
                total = scaled[names == name].sum(axis=0)
                sums[name] = sums[name] + total if name in sums else total
            if len(sums) > LANGS_PER_PASS:
                yield from _rows(sums)
                sums = {}
        yield from _rows(sums)

    def _rows(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, total in sums.items():
            names = pa.array([name] * dim, pa.string())
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(np.arange(dim, dtype=np.int32)), pa.array(total)], names=["lang", "place", "value"]
            )

    return (
        rows.where("lang IS NOT NULL AND text IS NOT NULL")
        .mapInArrow(run, "lang string, place int, value long")
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
    )


def _prototypes(learned: DataFrame, part: Sequence[str]) -> tuple[list[str], np.ndarray]:
    """Unit prototypes of the named languages; languages whose documents have no letter are left out."""
    sums: dict[str, dict[int, int]] = {}
    for row in learned.where(F.col("lang").isin(list(part))).toLocalIterator():
        sums.setdefault(row["lang"], {})[row["place"]] = row["value"]
    names, vectors = [], []
    for name in sorted(sums):
        vector = np.array([sums[name][k] for k in range(len(sums[name]))], dtype=np.float64)
        norm = np.linalg.norm(vector)
        if norm > 0:
            names.append(name)
            vectors.append(vector / norm)
    return names, np.array(vectors)


def predict(
    docs: DataFrame, learned: DataFrame, text: str = "text", dim: int = DIM, seed: int = SEED
) -> DataFrame:
    """``docs`` with lang_pred and score. ``learned`` is the result of ``learn``, written before."""
    rows = without(docs, *RESULTS)
    name, score = free_name(rows, "lang_pred"), free_name(rows, "score")
    schema = T.StructType(
        [*rows.schema.fields, T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())]
    )
    langs = [r["lang"] for r in learned.select("lang").distinct().orderBy("lang").toLocalIterator()]
    rows = rows.withColumns({name: F.lit(UNKNOWN), score: F.lit(_BELOW)})
    context = docs.sparkSession.sparkContext
    for start in range(0, len(langs), LANGS_PER_PASS):
        names, vectors = _prototypes(learned, langs[start : start + LANGS_PER_PASS])
        if names:
            rows = rows.mapInArrow(_comparer(context.broadcast((names, vectors)), text, name, score, dim, seed), schema)
    return rows.select(
        *[F.col(f"`{c}`") for c in rows.columns[:-2]], F.col(name).alias("lang_pred"), F.greatest(F.col(score), F.lit(0.0)).alias("score")
    )


def _comparer(shared, text: str, name: str, score: str, dim: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = shared.value
        letters = Letters(dim, seed)
        for batch in slices(batches):
            bundles = bundle(batch.column(text).to_pylist(), letters)
            # Rounded, so that the same text has the same score in whatever batch it comes.
            cosines = np.round(np.clip(bundles @ vectors.T, -1.0, 1.0), 6) + 0.0
            best = cosines.argmax(axis=1)
            top = cosines[np.arange(len(best)), best]
            lettered = bundles.any(axis=1)
            old_names, old_scores = batch.column(name).to_pylist(), batch.column(score).to_pylist()
            out_names, out_scores = [], []
            for k, row in enumerate(best):
                better = lettered[k] and top[k] > old_scores[k]
                out_names.append(names[row] if better else old_names[k])
                out_scores.append(float(top[k]) if better else old_scores[k])
            columns = [batch.column(c) for c in batch.schema.names if c not in (name, score)]
            others = [c for c in batch.schema.names if c not in (name, score)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(out_names, pa.string()), pa.array(out_scores, pa.float64())],
                names=[*others, name, score],
            )

    return run
