"""Written indexes.

The text index is a set of Parquet tables below one path. Postings and document lengths are bucketed
by ``doc_id``, so a search reads them already placed by document. Within a bucket, postings are in order
of their term, so the reader skips pages without the words asked for. Bucketing is known through the
session catalog; :func:`load_text_index` declares the tables there if they are not declared yet. The same
postings lie in blocks with upper bounds, bucketed by the shards of :mod:`rankloom.operators.postings_blocks`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, FloatType

from rankloom.functions.text import words
from rankloom.operators import postings_blocks
from rankloom.operators.lexical import (
    TextIndex,
    counted_postings,
    field_statistics,
    indexed_lengths,
)

_BUCKETED = {"postings": ("term", "doc_id"), "doc_len": ("doc_id",)}
_PLAIN = ("field_stats", "term_stats", "content_stats")

# Bytes of text per bucket. A task counts, sorts and encodes the words of one bucket, in tables that take up to
# some seventy times as much, so that they stay in memory however large the corpus is.
BUCKET_BYTES = 8 << 20


class IndexNotFound(FileNotFoundError):
    """The index files are not there."""


def check_documents(corpus: DataFrame) -> None:
    """Every document needs an id and no id may occur twice; otherwise three examples are shown."""
    faults = (
        corpus.groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("doc_id").isNull() | (F.col("copies") > 1))
    )
    shown = [f"{row.doc_id} ({row.copies} rows)" for row in faults.limit(3).toLocalIterator()]
    if shown:
        raise RuntimeError(f"documents without an id or with a repeated id: {', '.join(shown)}")


def latest_documents(corpus: DataFrame, sequence: str) -> DataFrame:
    """One row per ``doc_id``: the one with the highest ``sequence``, as a later write replaces an
    earlier one."""
    others = [name for name in corpus.columns if name not in ("doc_id", sequence)]
    newest = corpus.groupBy("doc_id").agg(F.max_by(F.struct(*others), F.col(sequence)).alias("newest"))
    return newest.select("doc_id", "newest.*")


def write_text_index(spark: SparkSession, corpus: DataFrame, path: str, buckets: int | None = None) -> TextIndex:
    """Build the index of ``corpus`` at ``path``, replacing what is there.

    A bucket is read by one task. By default there are as many as the measured text asks for, and no
    fewer than the shuffle partitions of the session.
    """
    check_documents(corpus)
    buckets = buckets or _bucket_count(spark, corpus)
    return write_checked(spark, corpus, path, buckets)


def write_checked(spark: SparkSession, corpus: DataFrame, path: str, buckets: int) -> TextIndex:
    """As :func:`write_text_index`, of documents that :func:`check_documents` let pass."""
    placed = corpus.select("doc_id", "title", "text").repartition(buckets, "doc_id")
    shards = postings_blocks.shard_numbers(spark, buckets)
    documents = postings_blocks.with_shard(placed, shards).select("shard", "doc_id", *[words(F.col(name)).alias(name) for name in ("title", "text")])
    key = corpus.schema["doc_id"].dataType
    # Blocks are several times fewer rows than postings, which are then read off them.
    _save_blocks(postings_blocks.pack(documents), path, key.simpleString(), buckets)
    with _whole_buckets(spark):
        blocks = spark.table(_table_name(path, "postings_blocks", key.simpleString(), buckets))
        _write_bucketed(postings_blocks.unpack(blocks), path, "postings", buckets)
    return _write_rest(spark, path, key, buckets, shards)


def _bucket_count(spark: SparkSession, corpus: DataFrame) -> int:
    return usual_buckets(spark, text_bytes(corpus))


def text_bytes(corpus: DataFrame) -> int:
    texts = F.coalesce(F.octet_length("title"), F.lit(0)) + F.coalesce(F.octet_length("text"), F.lit(0))
    return corpus.agg(F.coalesce(F.sum(texts.cast("bigint")), F.lit(0))).first()[0]


def usual_buckets(spark: SparkSession, size: int) -> int:
    """As many as ``size`` bytes of text ask for, and no fewer than the shuffle partitions of the session."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def upsert_text_index(
    spark: SparkSession, index: TextIndex, corpus: DataFrame, path: str, buckets: int | None = None
) -> TextIndex:
    """Write to a new ``path`` the index with the documents of ``corpus`` added or replaced.

    Postings of the other documents are taken over bucket by bucket: they are neither analysed nor
    moved between tasks, since the new index has the buckets of the old one unless told otherwise.
    Statistics are formed anew from the merged tables.
    """
    check_documents(corpus)
    buckets = buckets or index.buckets or _bucket_count(spark, corpus)
    return _write(spark, merged_postings(index, corpus, buckets), path, buckets)


def merged_postings(index: TextIndex, corpus: DataFrame, buckets: int) -> DataFrame:
    """Postings of ``index`` without the documents of ``corpus``, and theirs. Only the new ones move."""
    ids = corpus.select("doc_id").repartition(buckets, "doc_id")
    kept = index.postings.join(ids.hint("merge"), "doc_id", "left_anti")
    added = counted_postings(corpus.repartition(buckets, "doc_id"))
    if index.buckets != buckets:
        kept = kept.repartition(buckets, "doc_id")
    return kept.unionByName(added)


def _write(spark: SparkSession, postings: DataFrame, path: str, buckets: int) -> TextIndex:
    """``postings`` come placed by ``doc_id`` as the buckets are, so that every bucket is one file."""
    key = postings.schema["doc_id"].dataType
    _write_bucketed(postings, path, "postings", buckets)
    shards = write_blocks(spark, spark.table(_table_name(path, "postings", key.simpleString(), buckets)), path, buckets)
    return _write_rest(spark, path, key, buckets, shards)


def _write_rest(spark: SparkSession, path: str, doc_id: DataType, buckets: int, shards: list[int]) -> TextIndex:
    """The text is analysed once, for postings or blocks; all other tables are read off the written ones."""
    key = doc_id.simpleString()
    written = spark.table(_table_name(path, "postings", key, buckets))
    _write_bucketed(indexed_lengths(written), path, "doc_len", buckets)
    terms = postings_blocks.statistics(spark.table(_table_name(path, "postings_blocks", key, buckets)), buckets)
    terms.write.mode("overwrite").parquet(f"{path}/term_stats")
    # Blocks are many more than terms, and are gone over once.
    contents = postings_blocks.whole_statistics(spark.read.parquet(f"{path}/term_stats"), buckets)
    contents.write.mode("overwrite").parquet(f"{path}/content_stats")
    lengths = spark.table(_table_name(path, "doc_len", key, buckets))
    field_statistics(lengths).coalesce(1).write.mode("overwrite").parquet(f"{path}/field_stats")
    names = [row.field for row in spark.read.parquet(f"{path}/field_stats").select("field").collect()]
    known = sorted({"title", "text", *names})
    layout = spark.range(1).select(
        F.lit(buckets).alias("buckets"), F.lit(known).alias("names"), F.lit(shards).alias("shards"), *_key_sample(doc_id)
    )
    layout.coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    return load_text_index(spark, path)


def _write_bucketed(table: DataFrame, path: str, name: str, buckets: int) -> None:
    (
        table.write.mode("overwrite")
        .bucketBy(buckets, "doc_id")
        .sortBy(*_BUCKETED[name])
        .option("path", f"{path}/{name}")
        .saveAsTable(_table_name(path, name, table.schema["doc_id"].dataType.simpleString(), buckets))
    )


# Bucketed tables are read one bucket per task, also where the plan does not ask for it. Batches of postings are
# small by their number of rows; Spark then need not measure them after every row, which takes longer than all else.
_WHOLE_BUCKETS = {
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.execution.arrow.maxBytesPerBatch": str((1 << 31) - 1),
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(1 << 16),
}


@contextmanager
def _whole_buckets(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name) for name in _WHOLE_BUCKETS}
    for name, value in _WHOLE_BUCKETS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def write_blocks(spark: SparkSession, postings: DataFrame, path: str, buckets: int) -> list[int]:
    """The written postings again as blocks, bucket by bucket without moving them; their shards."""
    shards = postings_blocks.shard_numbers(spark, buckets)
    table = postings_blocks.pack(postings_blocks.with_shard(postings, shards))
    with _whole_buckets(spark):
        _save_blocks(table, path, postings.schema["doc_id"].dataType.simpleString(), buckets)
    return shards


def _save_blocks(table: DataFrame, path: str, key: str, buckets: int) -> None:
    (
        table.write.mode("overwrite")
        .bucketBy(buckets, "shard")
        .sortBy("term", "field")
        .option("path", f"{path}/postings_blocks")
        .saveAsTable(_table_name(path, "postings_blocks", key, buckets))
    )


def _key_sample(doc_id: DataType) -> list:
    """A null column that records the type of the document ids."""
    return [F.lit(None).cast(doc_id).alias("doc_id")]


def _table_name(path: str, name: str, key_type: str, buckets: int) -> str:
    """The name says all that the declaration depends on, so that one of this name fits."""
    return f"rankloom_{name}_{hashlib.md5(f'{path} {key_type}'.encode()).hexdigest()}_{buckets}"


def load_text_index(spark: SparkSession, path: str) -> TextIndex:
    """Open a written index; a missing one raises :class:`IndexNotFound`."""
    layout = _read(spark, f"{path}/layout", "text index")
    buckets, names = layout.select("buckets", "names").first()
    shards = layout.select("shards").first()[0] if "shards" in layout.columns else None
    key_type = layout.schema["doc_id"].dataType.simpleString()
    columns = {
        "postings": f"doc_id {key_type}, field STRING, term STRING, tf INT, dl INT",
        "doc_len": f"doc_id {key_type}, field STRING, dl INT",
    }
    tables = {
        name: _declared(spark, path, name, key_type, buckets, columns[name], "doc_id", order) for name, order in _BUCKETED.items()
    }
    tables |= {name: _read(spark, f"{path}/{name}", "text index").drop("again") for name in _PLAIN}
    blocks = ()
    if shards:
        kinds = f"shard INT, field STRING, term STRING, docs ARRAY<{key_type}>, tfs ARRAY<INT>, dls ARRAY<INT>, max_tf INT, min_dl INT, again INT"
        table = _declared(spark, path, "postings_blocks", key_type, buckets, kinds, "shard", ("term", "field"))
        blocks = (postings_blocks.BlockSet(table, tuple(shards)),)
    return TextIndex(**tables, names=tuple(names), buckets=buckets, blocks=blocks)


def _declared(
    spark: SparkSession, path: str, name: str, key_type: str, buckets: int, columns: str, by: str, order: tuple[str, ...]
) -> DataFrame:
    """A bucketed table below ``path``, made known to the session's catalog."""
    declared = _table_name(path, name, key_type, buckets)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {declared} ({columns}) USING parquet OPTIONS (path '{place}/{name}') "
        f"CLUSTERED BY ({by}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS"
    )
    spark.catalog.refreshTable(declared)
    return spark.table(declared)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("doc_id", "embedding").write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Open written vectors; anything but ``(doc_id, embedding array<float>)`` is refused."""
    vectors = _read(spark, path, "vector index")
    types = {field.name: field.dataType for field in vectors.schema.fields}
    embedding = types.get("embedding")
    valid = (
        "doc_id" in types
        and isinstance(embedding, ArrayType)
        and isinstance(embedding.elementType, FloatType)
    )
    if not valid:
        raise ValueError(
            f"invalid vector index at {path}: expected doc_id and embedding array<float>, "
            f"found {vectors.schema.simpleString()}"
        )
    return vectors.select("doc_id", "embedding")


def _read(spark: SparkSession, path: str, what: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise IndexNotFound(f"no {what} at {path}: there are no files to open") from error
        raise
