"""Sharding through fixed virtual slots.

A record belongs to one of some thousand slots by the hash of its key and text, for ever. Bytes are
summed per slot, and a small table, kept in versions, says which shard holds which slot. Slots are
given out from large to small, each to the shard with the fewest bytes, so shards come out near equal
in bytes. Rebalancing, or another number of shards, edits the table: slots leave only shards that are
gone or above their share, and are given out again in the same way; all other slots stay.

A slot with more bytes than one in ``PIECES`` parts of a mean shard is split: its rows are written once with
a number each, and dealt over as many parts as it takes by a hash of that number. The map then holds slot and
part, so that rows equal in key and text, however many, spread over the shards like all others. There
are fewer than ``PIECES`` such slots per shard.

All tables but the records have one row per slot and part. The law is `bytes`: sizes are near equal, as far
as single records are small against a shard.

Defined results: a null text has size 16 and the check sum of no bytes, 0. Rows equal in key and text share
a slot and its order is any among them; which of them goes to which part depends on where they lie in the
input. A very long text is one record and cannot be split. Slots of equal bytes are given out by their number,
shards of equal bytes and slots taken by theirs. Shards may stay empty when there are fewer slots in use than
shards. An empty table gives an empty table. Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rankloom.session import materialise

SLOTS = 8192
ROW_BYTES = 16
LAW = "bytes"
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot")

# A slot larger than this part of a mean shard is split.
PIECES = 16

_MAP = "slot int, part int, shard int"


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_BYTES)


def with_slots(docs: DataFrame, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with size and virtual_slot; __order orders the rows of a slot, __part is 0."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULTS]
    order = F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))
    return docs.select(
        *keep,
        record_size(F.col(f"`{text}`")).alias("size"),
        F.pmod(order, F.lit(slots)).cast("int").alias("virtual_slot"),
        order.alias("__order"),
        F.lit(0).alias("__part"),
    )


def slot_sizes(rows: DataFrame) -> DataFrame:
    """Rows and bytes per slot and part in use."""
    return rows.groupBy(F.col("virtual_slot").alias("slot"), F.col("__part").alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")
    )


def split_slots(rows: DataFrame, sizes: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``sizes`` with the rows of large slots dealt over parts.

    ``sizes`` has been written before. Rows of large slots are written with their parts, so that sizes and
    places are formed from the same ones, even if a task runs again.
    """
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    piece = max(1, total // (shards * PIECES))
    # Fewer than PIECES per shard can be above that.
    large = [(r["slot"], -(-r["bytes"] // piece)) for r in sizes.where((F.col("n") > 1) & (F.col("bytes") > piece)).toLocalIterator()]
    if not large:
        return rows, sizes
    spark = rows.sparkSession
    split = F.broadcast(spark.createDataFrame(large, "virtual_slot int, __parts int"))
    dealt = rows.join(split, "virtual_slot").withColumn("__number", F.monotonically_increasing_id())
    part = F.pmod(F.xxhash64("__number"), F.col("__parts")).cast("int")
    dealt = materialise(dealt.withColumn("__part", part).drop("__parts", "__number").select(*rows.columns), "large-slots")
    others = rows.join(split, "virtual_slot", "left_anti").select(*rows.columns)
    slots = split.select(F.col("virtual_slot").alias("slot"))
    small = sizes.join(slots, "slot", "left_anti").select("slot", "part", "n", "bytes")
    return others.unionByName(dealt), materialise(small.unionByName(slot_sizes(dealt)), "slot-sizes")


def assign_slots(
    sizes: DataFrame, shards: int, slots: int = SLOTS, previous: DataFrame | None = None, slack: float = 0.0
) -> DataFrame:
    """A map (slot, part, shard) for all slots: the next version after ``previous``, or a first one.

    Without a column part in ``sizes``, no slot is split.

    A shard of ``previous`` keeps its largest slots until it is ``slack`` above the mean. The rest is
    given out one slot after the other, as a fold over an array with one entry per slot.
    """
    spark = sizes.sparkSession
    if "part" not in sizes.columns:
        sizes = sizes.withColumn("part", F.lit(0))
    every = spark.range(slots).select(F.col("id").cast("int").alias("slot"), F.lit(0).alias("part"))
    used = sizes.select("slot", "part", "bytes")
    rows = every.join(F.broadcast(used.select("slot", "part")), ["slot", "part"], "left_anti").withColumn(
        "bytes", F.lit(0).cast("long")
    ).unionByName(used)
    if previous is None:
        rows = rows.withColumn("shard", F.lit(None).cast("int"))
    else:
        rows = rows.join(F.broadcast(previous.select("slot", "part", "shard")), ["slot", "part"], "left").withColumn(
            "shard", F.when(F.col("shard") < shards, F.col("shard"))
        )
    limit = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards) * F.lit(1 + slack)
    filled = F.sum("bytes").over(
        Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot", "part").rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = rows.withColumn("__limit", limit).withColumn(
        "shard", F.when(F.col("shard").isNotNull() & (filled <= F.col("__limit")), F.col("shard"))
    )
    kept = rows.where("shard IS NOT NULL").groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    loads = (
        spark.range(shards)
        .select(F.col("id").cast("int").alias("shard"))
        .join(F.broadcast(kept), "shard", "left")
        .select(
            F.struct(
                F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"),
                F.coalesce("n", F.lit(0).cast("long")).alias("n"),
                "shard",
            ).alias("load")
        )
    )
    free = rows.where("shard IS NULL").select(F.struct((-F.col("bytes")).alias("less"), "slot", "part").alias("free"))
    # One row that holds both lists; collecting leaves out the nulls of the other side.
    both = free.unionByName(loads, allowMissingColumns=True).agg(
        F.sort_array(F.collect_list("free")).alias("free"), F.sort_array(F.collect_list("load")).alias("loads")
    )

    def give(state: Column, slot: Column) -> Column:
        least = state["loads"][0]
        taken = F.struct(
            (least["bytes"] - slot["less"]).alias("bytes"), (least["n"] + 1).alias("n"), least["shard"].alias("shard")
        )
        others = F.slice(state["loads"], F.lit(2), F.greatest(F.size(state["loads"]) - 1, F.lit(0)))
        return F.struct(
            F.sort_array(F.concat(others, F.array(taken))).alias("loads"),
            F.concat(state["given"], F.array(least["shard"])).alias("given"),
        )

    start = F.struct("loads", F.array().cast("array<int>").alias("given"))
    given = (
        both.select("free", F.aggregate("free", start, give)["given"].alias("given"))
        .select(F.explode(F.arrays_zip("free", "given")).alias("x"))
        .select(F.col("x.free.slot").alias("slot"), F.col("x.free.part").alias("part"), F.col("x.given").alias("shard"))
    )
    return rows.where("shard IS NOT NULL").select("slot", "part", "shard").unionByName(given)


def store_map(shard_map: DataFrame, folder: str, version: int) -> None:
    """Write one version of the map; a version is written once and never changed."""
    shard_map.coalesce(1).write.parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(_MAP).parquet(f"{folder}/version={version}")


def deal(rows: DataFrame, sizes: DataFrame, shard_map: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``with_slots`` with their shard and their place in it, from 0 without gaps.

    Rows are only numbered within their virtual slot and part; the first place of those in the shard comes
    from the counts. ``sizes`` and ``shard_map`` have one row per slot and part and are broadcast.
    """
    earlier = Window.partitionBy("shard").orderBy("virtual_slot", "__part").rowsBetween(Window.unboundedPreceding, -1)
    places = shard_map.join(F.broadcast(sizes), ["slot", "part"]).select(
        F.col("slot").alias("virtual_slot"), F.col("part").alias("__part"), "shard", "n"
    ).withColumn("__start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy("virtual_slot", "__part").orderBy("__order")) - 1
    keep = [F.col(f"`{c}`") for c in rows.columns if c not in ("size", "virtual_slot", "__order", "__part")]
    return (
        rows.withColumn("text_crc32", F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))
        .withColumn("__number", number)
        .join(F.broadcast(places), ["virtual_slot", "__part"])
        .select(
            *keep,
            "size",
            "text_crc32",
            F.lit(LAW).alias("law"),
            "shard",
            (F.col("__start") + F.col("__number")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
        )
    )


def shard(docs: DataFrame, shards: int, map_folder: str, version: int = 1, slots: int = SLOTS) -> DataFrame:
    """All of ``docs`` in ``shards`` shards, through the map stored as ``version`` in ``map_folder``.

    Version 1 is made from nothing, a later one from the version before it.
    """
    spark = docs.sparkSession
    rows = with_slots(docs, slots)
    rows, sizes = split_slots(rows, materialise(slot_sizes(rows), "slot-sizes"), shards)
    previous = load_map(spark, map_folder, version - 1) if version > 1 else None
    store_map(assign_slots(sizes, shards, slots, previous), map_folder, version)
    return deal(rows, sizes, load_map(spark, map_folder, version))
