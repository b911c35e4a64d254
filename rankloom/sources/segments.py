"""A text index that grows by segments.

Every write adds a segment: a written index of its own, never changed afterwards. A document that is written
again, or deleted, is entered in the deletion set of the segment that holds it, together with what its
postings took part in: so statistics of the whole are sums over segments and deletions, and an upsert writes
about as much as the documents it brings, however large the index is.

The manifest names the segments and deletion sets that make up a version. A version is written last, in one
row, and a failed upsert leaves only files that no version names. Segments of like size, and those with
many deleted documents, are merged into one by a rule; the rest stay as they are.

    path/segments/<name>      an index as of :mod:`rankloom.sources.indexes`
    path/deletions/<number>   gone, terms, contents, sums: by segment
    path/manifest/<number>    one row per version
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.operators.lexical import TextIndex
from rankloom.operators.postings_blocks import BlockSet, with_shard
from rankloom.session import materialise
from rankloom.sources import indexes
from rankloom.sources.indexes import IndexNotFound, check_documents, load_text_index

# Segments of one tier have live documents within this factor of each other; so many of them are merged.
TIER = 4
# A segment of which more than this part is deleted is written anew.
MOST_DELETED = 0.5
# Documents that are looked up by their ids, so that other buckets need not be read.
FEW = 1000
# Text per bucket of a small segment.
_SMALL_BUCKET = 1 << 20

_MANIFEST = "version int, segments array<struct<name: string, documents: bigint, deleted: bigint>>, deletions array<struct<name: string, segments: array<string>>>"


@dataclass(frozen=True)
class Segment:
    name: str
    documents: int
    deleted: int = 0

    @property
    def live(self) -> int:
        return self.documents - self.deleted


@dataclass(frozen=True)
class Deletions:
    """A deletion set and the segments it takes documents from."""

    name: str
    segments: tuple[str, ...]


@dataclass(frozen=True)
class Manifest:
    version: int
    segments: tuple[Segment, ...]
    deletions: tuple[Deletions, ...] = ()


def read_manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The newest version, or the one that is named."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/*")
        newest = rows.where(F.lit(True) if version is None else F.col("version") == version).orderBy(F.desc("version")).first()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise IndexNotFound(f"no segmented index at {path}: there is no manifest") from error
        raise
    if newest is None:
        raise IndexNotFound(f"the index at {path} has no version {version}")
    return Manifest(
        newest.version,
        tuple(Segment(s.name, s.documents, s.deleted) for s in newest.segments),
        tuple(Deletions(d.name, tuple(d.segments)) for d in newest.deletions),
    )


def _write_manifest(spark: SparkSession, path: str, manifest: Manifest) -> None:
    row = (
        manifest.version,
        [(s.name, s.documents, s.deleted) for s in manifest.segments],
        [(d.name, list(d.segments)) for d in manifest.deletions],
    )
    # A version that is there already makes this fail: of two writers at once, one does not get through.
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.parquet(f"{path}/manifest/{manifest.version}")


def create(spark: SparkSession, corpus: DataFrame, path: str, buckets: int | None = None) -> TextIndex:
    """A new index at ``path``, with one segment."""
    segment = _write_segment(spark, corpus, path, buckets)
    _write_manifest(spark, path, Manifest(1, (segment,) if segment else ()))
    return open_index(spark, path)


def upsert(spark: SparkSession, corpus: DataFrame, path: str, buckets: int | None = None) -> TextIndex:
    """A new version with the documents of ``corpus`` added, or put in the place of those of the same id."""
    before = read_manifest(spark, path)
    segment = _write_segment(spark, corpus, path, buckets)
    after = _without(spark, path, before, corpus.select("doc_id"))
    segments = (*after.segments, segment) if segment else after.segments
    _write_manifest(spark, path, Manifest(before.version + 1, segments, after.deletions))
    return open_index(spark, path)


def delete(spark: SparkSession, ids: DataFrame, path: str) -> TextIndex:
    """A new version without the documents of ``ids(doc_id)``; unknown ids do no harm."""
    before = read_manifest(spark, path)
    after = _without(spark, path, before, ids.select("doc_id").distinct())
    _write_manifest(spark, path, Manifest(before.version + 1, after.segments, after.deletions))
    return open_index(spark, path)


def _write_segment(spark: SparkSession, corpus: DataFrame, path: str, buckets: int | None) -> Segment | None:
    """The documents as a segment; none if there are none. Small ones get few buckets."""
    check_documents(corpus)
    name = f"segment-{uuid.uuid4().hex}"
    if not buckets:
        size = indexes.text_bytes(corpus)
        buckets = max(1, min(indexes.usual_buckets(spark, size), -(-size // _SMALL_BUCKET)))
    written = indexes.write_checked(spark, corpus, f"{path}/segments/{name}", buckets)
    return Segment(name, written.n_docs) if written.n_docs else None


# Segments never change, so an application opens each once.
_opened: dict[tuple[str, str], TextIndex] = {}


def _open_segment(spark: SparkSession, path: str, segment: Segment) -> TextIndex:
    key = (spark.sparkContext.applicationId, f"{path}/segments/{segment.name}")
    if key not in _opened:
        _opened[key] = load_text_index(spark, key[1])
    return _opened[key]


def _gone(spark: SparkSession, path: str, manifest: Manifest, segment: str) -> DataFrame | None:
    """Documents of a segment that no longer count: (doc_id)."""
    own = [d for d in manifest.deletions if segment in d.segments]
    if not own:
        return None
    rows = [spark.read.parquet(f"{path}/deletions/{d.name}/gone") for d in own]
    return reduce(DataFrame.unionByName, rows).where(F.col("segment") == segment).select("doc_id")


def _without(spark: SparkSession, path: str, manifest: Manifest, ids: DataFrame) -> Manifest:
    """``manifest`` with a deletion set for the live documents among ``ids``, if there are any."""
    # The text they may come with is gone through once.
    ids = materialise(ids, "changed-documents")
    found, postings, counts = [], [], {}
    few = ids.limit(FEW + 1).collect()
    wanted = [r[0] for r in few]
    for segment in manifest.segments:
        index = _open_segment(spark, path, segment)
        # With few ids Spark reads the buckets they lie in, and no others.
        near = F.col("doc_id").isin(wanted) if len(few) <= FEW else F.lit(True)
        here = index.doc_len.where(near).select("doc_id").distinct().join(ids, "doc_id", "left_semi")
        before = _gone(spark, path, manifest, segment.name)
        if before is not None:
            here = here.join(before, "doc_id", "left_anti")
        here = materialise(here, "deleted-documents")
        counts[segment.name] = here.count()
        if counts[segment.name]:
            name = F.lit(segment.name).alias("segment")
            found.append(here.select(name, "doc_id"))
            postings.append(index.postings.where(near).join(here, "doc_id", "left_semi").select(name, "*"))
    if not found:
        return manifest
    name = f"deletions-{uuid.uuid4().hex}"
    folder = f"{path}/deletions/{name}"
    lost = materialise(reduce(DataFrame.unionByName, postings), "deleted-postings")
    gone = reduce(DataFrame.unionByName, found)
    # What is written here is as large as what is deleted.
    for table, rows in (
        ("gone", gone),
        ("terms", lost.groupBy("segment", "field", "term").agg((-F.count(F.lit(1))).alias("df"))),
        (
            "contents",
            lost.select("segment", "doc_id", "term").distinct().groupBy("segment", "term").agg((-F.count(F.lit(1))).alias("df")),
        ),
        ("sums", _field_sums(lost.select("segment", "doc_id", "field", "dl").distinct(), "segment", sign=-1)),
    ):
        rows.coalesce(max(1, -(-sum(counts.values()) // 100_000))).write.parquet(f"{folder}/{table}")
    segments = tuple(Segment(s.name, s.documents, s.deleted + counts[s.name]) for s in manifest.segments)
    touched = tuple(s for s, n in counts.items() if n)
    return Manifest(manifest.version, segments, (*manifest.deletions, Deletions(name, touched)))


def _field_sums(lengths: DataFrame, *by: str, sign: int = 1) -> DataFrame:
    """Documents and words per field, as whole numbers that can be added up."""
    return lengths.groupBy(*by, "field").agg(
        (F.lit(sign) * F.count(F.lit(1))).alias("n_docs"), (F.lit(sign) * F.sum(F.col("dl").cast("bigint"))).alias("words")
    )


def open_index(spark: SparkSession, path: str, version: int | None = None) -> TextIndex:
    """The index as of a version: tables over all live documents, and the blocks of every segment."""
    manifest = read_manifest(spark, path, version)
    if not manifest.segments:
        raise IndexNotFound(f"the index at {path} has no documents")
    live = [s.name for s in manifest.segments]
    postings, lengths, blocks, names = [], [], [], set()
    terms, contents, sums = [], [], []
    for segment in manifest.segments:
        index = _open_segment(spark, path, segment)
        gone = _gone(spark, path, manifest, segment.name)
        names |= set(index.names)
        lengths.append(index.doc_len if gone is None else index.doc_len.join(gone, "doc_id", "left_anti"))
        postings.append(index.postings if gone is None else index.postings.join(gone, "doc_id", "left_anti"))
        terms.append(index.term_stats.select("field", "term", "df"))
        contents.append(index.content_stats.select("term", "df"))
        sums.append(_field_sums(index.doc_len))
        for block_set in index.blocks:
            lost = None if gone is None else with_shard(gone, list(block_set.shards))
            blocks.append(BlockSet(block_set.blocks, block_set.shards, lost))
    for deletions in manifest.deletions:
        folder = f"{path}/deletions/{deletions.name}"
        for table, parts in (("terms", terms), ("contents", contents), ("sums", sums)):
            rows = spark.read.parquet(f"{folder}/{table}").where(F.col("segment").isin(live)).drop("segment")
            parts.append(rows)

    def added(parts: Sequence[DataFrame], *by: str) -> DataFrame:
        return reduce(DataFrame.unionByName, parts).groupBy(*by).agg(F.sum("df").alias("df")).where("df > 0")

    fields = reduce(DataFrame.unionByName, sums).groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("words").alias("words"))
    whole = len(manifest.segments) == 1 and not manifest.deletions
    return TextIndex(
        reduce(DataFrame.unionByName, postings),
        reduce(DataFrame.unionByName, lengths),
        fields.where("n_docs > 0").select("field", "n_docs", (F.col("words") / F.col("n_docs")).alias("avgdl")),
        added(terms, "field", "term"),
        added(contents, "term"),
        tuple(sorted(names)),
        index.buckets if whole else None,
        tuple(blocks),
    )


def due(segments: Sequence[Segment], tier: int = TIER, most_deleted: float = MOST_DELETED) -> list[tuple[Segment, ...]]:
    """Which segments are to be merged: those of a tier that is full, and any with too many deletions.

    The tier of a segment is the whole part of the logarithm of its live documents to the base ``tier``, so a
    document is written again at most once per tier.
    """
    tiers: dict[int, list[Segment]] = {}
    for segment in segments:
        tiers.setdefault(int(math.log(max(1, segment.live), tier)), []).append(segment)
    found = [tuple(group) for _, group in sorted(tiers.items()) if len(group) >= tier]
    taken = {s.name for group in found for s in group}
    found += [(s,) for s in segments if s.name not in taken and s.deleted > most_deleted * s.documents]
    return found


def merge(spark: SparkSession, path: str, tier: int = TIER, most_deleted: float = MOST_DELETED) -> TextIndex:
    """A new version with the segments that are due put together; the same version if none is.

    Postings are taken over as they are: no text is analysed again.
    """
    manifest = read_manifest(spark, path)
    groups = due(manifest.segments, tier, most_deleted)
    if not groups:
        return open_index(spark, path)
    segments = list(manifest.segments)
    for group in groups:
        merged = _merge(spark, path, manifest, group)
        segments = [s for s in segments if s not in group] + ([merged] if merged else [])
    live = {s.name for s in segments}
    # Deletion sets of merged segments have done their work.
    kept = tuple(
        Deletions(d.name, tuple(s for s in d.segments if s in live)) for d in manifest.deletions if live.intersection(d.segments)
    )
    _write_manifest(spark, path, Manifest(manifest.version + 1, tuple(segments), kept))
    return open_index(spark, path)


def _merge(spark: SparkSession, path: str, manifest: Manifest, group: Sequence[Segment]) -> Segment | None:
    parts, buckets = [], 1
    for segment in group:
        index = _open_segment(spark, path, segment)
        gone = _gone(spark, path, manifest, segment.name)
        parts.append(index.postings if gone is None else index.postings.join(gone, "doc_id", "left_anti"))
        buckets = max(buckets, index.buckets)
    name = f"segment-{uuid.uuid4().hex}"
    total = sum(s.live for s in group)
    # As many buckets as the largest has, and more as documents are added to it.
    buckets = max(1, math.ceil(buckets * total / max(1, max(s.documents for s in group))))
    postings = reduce(DataFrame.unionByName, parts).repartition(buckets, "doc_id")
    written = indexes._write(spark, postings, f"{path}/segments/{name}", buckets)
    return Segment(name, written.n_docs) if written.n_docs else None


