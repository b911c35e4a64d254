"""Near-duplicate texts: a join on the Jaccard similarity of word n-grams, with Bayesian pruning.

Every text becomes the set of its runs of five words. Texts with equal sets are one class, and only
classes are compared. MinHash values of a class fill bands; classes that agree in a band meet in the bucket of
that band: at similarity 0.8 a pair misses all 32 bands of 4 with probability 5e-8. A pair is compared in the
bucket of its first common band and in no other. Buckets whose classes all met in one earlier bucket are left
out, so a class mostly goes to one bucket. Buckets are not joined to larger groups before pairs are verified.
Within a bucket, pairs are compared by their MinHash values a few at a time. After each step the posterior
probability that the similarity reaches the threshold, given the agreements so far and a flat prior,
decides: below ``tolerance`` the pair is dropped. The pairs left are verified on their whole sets.

Only the texts of classes in buckets are read again: a Bloom filter of bounded size keeps most others
from being moved, and an exact join removes what it lets pass. Buckets of any size are dealt into blocks, and
tasks compare pairs of blocks with arrays; what leaves a task is one row per class with its number of linked
documents and the smallest class it hangs together with. Neither pairs nor groups are ever gathered, and no
partner is left out.

Sets are held as 64-bit hashes of their n-grams; classes are told apart by two 64-bit hashes of the set and
its size, and numbered. Defined results: very long texts are read whole; a text of one to four words is one short n-gram; null texts and texts without
words link with nothing. Rows with equal id and text are told by their number only. Ids may be null; the
smallest id of a group that is not null names it. An empty table gives an empty table. Only the named
columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rankloom.llm import bloom
from rankloom.llm.blocks import Forest, plan_groups, to_units
from rankloom.llm.common import slices, words_of
from rankloom.llm.components import HUBS, components
from rankloom.session import materialise


@dataclass(frozen=True)
class Settings:
    n: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 4
    # MinHash values compared between two looks at the posterior, and where it drops a pair.
    step: int = 32
    tolerance: float = 1e-7
    # Numbers of one block: n-grams and MinHash values of its classes, 8 bytes each.
    block_weight: int = 1 << 19
    seed: int = 9

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 4096


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(raw: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; of a shorter text, of all its words."""
    words = words_of(raw or b"")
    if not words:
        return np.zeros(0, np.uint64)
    hashed = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    size = min(n, len(hashed))
    total = np.full(len(hashed) - size + 1, size, np.uint64)
    for k in range(size):
        total = _mixed(total * _STEP + hashed[k : k + len(total)])
    return np.unique(total)


def min_hashes(grams: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Smallest high half of ``factor * gram + term`` for every factor."""
    least = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(grams), _CHUNK):
        part = grams[start : start + _CHUNK, None] * factors[None, :] + terms[None, :]
        least = np.minimum(least, (part >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return least


def band_hashes(values: np.ndarray, settings: Settings) -> np.ndarray:
    total = _mixed(np.arange(1, settings.bands + 1, dtype=np.uint64) * _STEP)
    for column in values.reshape(settings.bands, settings.rows).T:
        total = _mixed(total * _STEP + column.astype(np.uint64))
    return total.view(np.int64)


def _hash_family(settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(settings.seed))
    factors = random.integers(0, 2**63, settings.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, random.integers(0, 2**63, settings.hashes, dtype=np.uint64)


def least_agreements(settings: Settings) -> list[tuple[int, int]]:
    """(values compared, agreements a pair then needs) for every look at the posterior.

    With a flat prior and m of n agreements the similarity follows Beta(m+1, n-m+1), and the probability
    of t or more is that of at most m successes in n+1 trials of chance t.
    """
    t, looks = settings.threshold, []
    for n in [*range(settings.step, settings.hashes, settings.step), settings.hashes]:
        below, m = 0.0, -1
        while below < settings.tolerance:
            m += 1
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        looks.append((n, m))
    return looks


def _text_key(text: str = "text") -> Column:
    return F.xxhash64(F.col(text))


def signatures(rows: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, key (of the text), print and proof (of the set), size and bands; these are null without words.

    ``bands`` has one hash per band, made of the band's number and its MinHash values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, terms = _hash_family(settings)
        for batch in slices(batches, 256):
            prints, proofs, sizes, bands = [], [], [], []
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                grams = shingles(raw, settings.n)
                sizes.append(len(grams))
                if len(grams):
                    prints.append(int(_mixed(np.cumsum(_mixed(grams + _STEP))[-1:])[0].astype(np.int64)))
                    proofs.append(int(_mixed(np.cumsum(_mixed(grams * _MIX[1]))[-1:])[0].astype(np.int64)))
                    bands.append(band_hashes(min_hashes(grams, factors, terms), settings))
                else:
                    prints.append(None)
                    proofs.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array(prints, pa.int64()),
                    pa.array(proofs, pa.int64()),
                    pa.array(sizes, pa.int32()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "print", "proof", "size", "bands"],
            )

    return rows.mapInArrow(run, "doc_id long, key long, print long, proof long, size int, bands array<long>")


def candidate_buckets(classes: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """``(members, buckets)``: node, number and band of every class in a bucket, and band with its weight.

    Buckets whose classes all have the same first bucket, another than this one, are left out: all their pairs
    meet there. Both tables have been written.
    """
    filled = classes.select("node", "size", F.posexplode("bands").alias("number", "band"))
    shared = filled.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = materialise(filled.join(shared, "band"), "ngram-met")
    first = met.groupBy("node").agg(F.min(F.struct("number", "band")).alias("first"))
    told = met.join(first, "node")
    buckets = told.groupBy("band").agg(
        F.min("number").alias("number"),
        F.sum(F.col("size") + settings.hashes).alias("weight"),
        F.min("first.band").alias("least"),
        F.max("first.band").alias("most"),
    )
    own = (F.col("least") != F.col("most")) | (F.col("least") == F.col("band"))
    buckets = materialise(buckets.where(own).select("band", "weight"), "ngram-buckets")
    return met.select("node", "number", "band").join(buckets.select("band"), "band", "left_semi"), buckets


def _with_shingles(rows: DataFrame, settings: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, terms = _hash_family(settings)
        for batch in slices(batches, 256):
            grams = [shingles(raw, settings.n) for raw in batch.column("text").cast(pa.binary()).to_pylist()]
            sigs = [min_hashes(g, factors, terms).view(np.int32) for g in grams]
            others = [name for name in batch.schema.names if name != "text"]
            columns = [batch.column(name) for name in others]
            columns.append(pa.array(sigs, pa.list_(pa.int32())))
            columns.append(pa.array([g.view(np.int64) for g in grams], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "sig", "grams"])

    schema = "node long, copies long, met array<struct<band: long, number: int, blocks: int>>, sig array<int>, grams array<long>"
    return rows.select("node", "copies", "met", "text").mapInArrow(run, schema)


class _Side:
    """Classes of one bucket in one unit, as arrays."""

    def __init__(self, sigs: np.ndarray, grams: list[np.ndarray]):
        self.sigs = sigs
        self.sizes = np.array([len(g) for g in grams], np.int64)
        _, numbers = np.unique(np.concatenate(grams), return_inverse=True)
        self.ends = np.cumsum(self.sizes)
        self.numbers = np.split(numbers, self.ends[:-1])
        self.mark = np.zeros(int(numbers.max()) + 1, bool)

    def first_met(self, k: int, others: np.ndarray, number: int, rows: int) -> np.ndarray:
        """Those of ``others`` that agree with ``k`` in no band before the one of this number."""
        before = self.sigs[others, : number * rows] == self.sigs[k, : number * rows]
        return others[~before.reshape(len(others), number, rows).all(axis=2).any(axis=1)]

    def links(self, k: int, others: np.ndarray, looks: list[tuple[int, int]], threshold: float) -> np.ndarray:
        """Those of ``others`` whose similarity with ``k`` reaches the threshold."""
        agreed, seen, mine = np.zeros(len(others), np.int64), 0, self.sigs[k]
        for n, need in looks:
            agreed = agreed + (self.sigs[others, seen:n] == mine[seen:n]).sum(axis=1)
            alive = agreed >= need
            others, agreed, seen = others[alive], agreed[alive], n
            if not len(others):
                return others
        self.mark[self.numbers[k]] = True
        common = np.array([np.count_nonzero(self.mark[self.numbers[j]]) for j in others])
        self.mark[self.numbers[k]] = False
        union = self.sizes[k] + self.sizes[others] - common
        return others[common / union >= threshold]


def compare(rows: DataFrame, settings: Settings) -> DataFrame:
    """node, links (documents in linked classes) and least, for classes that have any in a unit."""
    looks = least_agreements(settings)

    def run(unit: pa.Table) -> pa.Table:
        nodes = unit.column("node").to_numpy()
        copies = unit.column("copies").to_numpy()
        block, left, right = (unit.column(c).to_numpy() for c in ("block", "left", "right"))
        groups, numbers = unit.column("band").to_numpy(), unit.column("number").to_numpy()
        sigs = unit.column("sig").combine_chunks().flatten().to_numpy().reshape(len(nodes), -1)
        column = unit.column("grams").combine_chunks()
        grams = np.split(column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())[:-1])
        links, forest = np.zeros(len(nodes), np.int64), Forest(nodes)
        order = np.lexsort((nodes, groups))
        for at in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1):
            side = _Side(sigs[at], [grams[k] for k in at])
            first = left[at[0]] == block[at]
            apart = left[at[0]] != right[at[0]]
            for k in range(len(at)):
                if apart and not first[k]:
                    continue
                others = np.flatnonzero(~first) if apart else np.arange(k + 1, len(at))
                others = side.first_met(k, others, int(numbers[at[0]]), settings.rows)
                near = side.links(k, others, looks, settings.threshold) if len(others) else others
                if len(near):
                    links[at[k]] += copies[at[near]].sum()
                    links[at[near]] += copies[at[k]]
                    forest.join(at[k], at[near])
        least = forest.names()
        told = links > 0
        return pa.table({"node": nodes[told], "links": links[told], "least": least[told]})

    return rows.groupBy("unit").applyInArrow(run, "node long, links long, least long")


def join(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, class_id, n_links, component_id and kept; one row per document.

    ``class_id`` is the smallest id with an equal n-gram set, ``n_links`` the number of other documents
    whose similarity reaches the threshold, ``component_id`` the smallest id reachable by links, and
    ``kept`` marks one document of each component. ``key`` is a hash of the text.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn(
        "key", _text_key()
    )
    signed = materialise(signatures(rows, settings), "ngram-signatures")
    classes = (
        signed.where("print IS NOT NULL")
        .groupBy("print", "proof", "size")
        .agg(
            F.count("*").alias("copies"),
            # Equal sets have equal bands; the first row with the smallest id stands for the class.
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"),
            F.first("bands").alias("bands"),
        )
        .select("print", "proof", "size", "copies", "first.doc_id", "first.key", "bands")
    )
    # Numbered once and written, so that a class keeps its number.
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "ngram-classes")
    members, buckets = candidate_buckets(classes, settings)
    planned = materialise(plan_groups(buckets, settings.block_weight), "ngram-blocks")
    total = planned.where("blocks = 1").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()["w"]
    bins = max(1, -(-total // settings.block_weight))
    # Each class with its buckets, one for every band at most: its set is moved once, to where it is compared.
    members = members.join(planned.select("band", "blocks"), "band").groupBy("node").agg(
        F.collect_list(F.struct("band", "number", "blocks")).alias("met")
    )
    asked = classes.join(members, "node").select(
        "node", "copies", "met", F.col("doc_id").alias("first_id"), F.col("key").alias("first_key")
    )
    asked = materialise(asked, "ngram-asked")
    blocks = bloom.block_count(asked.count())
    near = bloom.mark(rows, "key", bloom.build(asked, "first_key", blocks), blocks).where("possible")
    texts = near.join(
        asked, (near["key"] == asked["first_key"]) & near["doc_id"].eqNullSafe(asked["first_id"])
    ).dropDuplicates(["node"])
    dealt = _with_shingles(texts, settings).select("node", "copies", "sig", "grams", F.inline("met"))
    units = to_units(dealt, "node", F.col("band"), F.col("blocks"), bins)
    compared = materialise(compare(units, settings), "ngram-links")

    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(compared.select(F.col("node").alias("u"), F.col("least").alias("v")), "ngram-components")
    heads = (
        classes.select("print", "proof", "size", "node", "copies", F.col("doc_id").alias("class_id"))
        .join(links, "node", "left")
        .join(parts, "node", "left")
        .withColumn("part", F.coalesce("component", "node"))
        .drop("component")
    )
    heads = materialise(heads, "ngram-heads")
    leading = heads.groupBy("part").agg(
        F.min(F.struct(F.col("class_id").isNull().alias("none"), "class_id", "node")).alias("head"),
        F.count(F.lit(1)).alias("n"),
    )
    leading = materialise(leading.where("n > 1"), "ngram-leading")
    # Fewer than HUBS groups hold more than one part in HUBS of the classes.
    limit = F.lit(heads.count() // HUBS)
    told = F.broadcast(leading.where(F.col("n") > limit).select("part", "head"))
    alone = F.struct(F.col("class_id").isNull().alias("none"), "class_id", "node")
    rest = leading.where(F.col("n") <= limit).select("part", F.col("head").alias("other"))
    # Classes that are told already meet nothing, each under its own number.
    key = F.when(F.col("head").isNull(), F.col("part")).otherwise(-1 - F.col("node"))
    heads = heads.join(told, "part", "left").withColumn("key", key).join(
        rest.withColumnRenamed("part", "key"), "key", "left"
    ).withColumn("head", F.coalesce("head", "other", alone)).select(
        "print",
        "proof",
        "size",
        "class_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.col("head.class_id").alias("component_id"),
        (F.col("head.node") == F.col("node")).alias("leads"),
    )
    return signed.select("doc_id", "key", "print", "proof", "size").join(heads, ["print", "proof", "size"], "left").select(
        "doc_id",
        "key",
        F.when(F.col("leads").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("leads").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("leads").isNull() | (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class_id")))).alias("kept"),
    )


def keep_one(docs: DataFrame, joined: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that ``join`` keeps, one row of those equal in id and text.

    ``joined`` has been written before. Most documents are kept and occur once; a Bloom filter of the
    others lets them pass without being moved. The rest meet the decisions in an exact join.
    """
    names = docs.columns
    decided = joined.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept"))
    special = materialise(decided.where("n > 1 OR NOT kept"), "ngram-dropped")
    rows = docs.withColumn("__text", F.xxhash64(F.col(f"`{text}`")))
    blocks = bloom.block_count(special.count())
    rows = bloom.mark(rows, "__text", bloom.build(special, "key", blocks), blocks, "__possible")
    decisions = special.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("kept").alias("__kept"))
    same = (F.col("__text") == F.col("__key")) & F.col(f"`{key}`").cast("long").eqNullSafe(F.col("__id"))
    met = rows.where("__possible").join(decisions, same, "left")
    repeated = met.where("__kept").dropDuplicates([key, "__text"])
    plain = rows.where("NOT __possible").unionByName(met.where("__kept IS NULL").select(*rows.columns))
    columns = [F.col(f"`{c}`") for c in names]
    return plain.select(*columns).unionByName(repeated.select(*columns))
