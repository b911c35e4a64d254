"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies: the source's target over its size.
The expected copies are summed along the source, one random offset per source is added, and a
document is emitted once for every integer boundary that its own share of the sum crosses. Documents
are summed from large to small, so the words taken from a source miss its target by less than its
largest document, whatever the offset.

The prefix sum of a source never meets in one task. Documents are counted in cells (source, size
class, hash of the row); the counts are summed along classes and cells, and rows are only numbered
within their own cell. A source may hold any part of all rows. Equal rows share a cell; where there are very
many of one kind, they are written with a number each and dealt over parts of the cell, which follow each other
in the sum, so it does not matter which of them is in which part.

Defined results: a null or blank text has size 0 and is emitted like any other document of its
source, adding no words. A null source is a source of its own. A source with weight null, 0 or
below, or of size 0, has target 0 and gives nothing. Rows equal in every respect are interchangeable.
Documents of one size class are summed by hash, which decides ties; a very long text is one document
and its words are counted where it lies. Maps and variants take no part in the hash. An empty table gives an
empty table. Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.session import materialise

# White space between words: blank and the control characters from tab to carriage return.
WORD_RUN = r"[^\x20\x09-\x0D]+"

RESULTS = ("size", "source_size", "target", "copies", "taken")

# Cells per size class of a source: at 10^11 documents a cell of a source with a third of them has
# some hundred thousand rows.
CELLS = 1024

# Equal rows that one task may number; more where there would be more than KINDS parts otherwise.
PART_ROWS = 1 << 14
KINDS = 1 << 16

_OFFSET_STEPS = 1 << 20
_KEY = ["__src", "__none", "__class", "__cell"]
# Equal rows in large numbers are a part of their cell; all others are in the part with hash 0 and number 0.
_PART = [*_KEY, "__kind", "__part"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RUN)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Number of digits and the two leading ones: classes in size order, at most a tenth wide."""
    digits = size.cast("string")
    return F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.rpad(F.substring(digits, 1, 2), 2, "0"))


def targets(sizes: DataFrame, weights: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets per source: ``share`` of all sizes dealt by weight, none above ``cap`` of its own size.

    ``sizes`` has __src, __none and source_size, one row per source; ``weights`` has __src, __none and
    weight. What sources above their cap leave over goes to the others by weight until none is above:
    sources are filled up to a common level of target per weight. With sources in order of cap per
    weight, the level is found from running sums. Both tables have one row per source.
    """
    rows = (
        sizes.join(weights, ["__src", "__none"], "left")
        .withColumn("weight", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)))
        .withColumn("__cap", F.when(F.col("weight") > 0, F.col("source_size") * F.lit(cap)).otherwise(F.lit(0.0)))
        .withColumn("__ratio", F.when(F.col("weight") > 0, F.col("__cap") / F.col("weight")).otherwise(F.lit(0.0)))
    )
    every = Window.partitionBy()
    ordered = Window.orderBy("__ratio", "__none", "__src")
    before = F.coalesce(F.sum("__cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    remaining = F.sum("weight").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(every) * F.lit(share)
    rows = rows.withColumn("__level", F.when(remaining > 0, (total - before) / remaining))
    level = F.max(F.when(F.col("__ratio") >= F.col("__level"), F.col("__level"))).over(every)
    return rows.withColumn("__water", level).select(
        "__src",
        "__none",
        "source_size",
        # No level fits only if all sources together stay below the share; then all are at their cap.
        F.least(F.col("__cap"), F.coalesce(F.col("__water") * F.col("weight"), F.col("__cap"))).alias("target"),
    )


def _split_equal(rows: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``cells`` with __kind and __part: equal rows in large numbers are dealt over parts."""
    nought = {"__kind": F.lit(0).cast("long"), "__part": F.lit(0).cast("long")}
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(PART_ROWS, total // KINDS)
    large = cells.where(F.col("n") > limit).select(*_KEY)
    if not large.limit(1).count():
        return rows.withColumns(nought), cells.withColumns(nought)
    # Fewer than KINDS cells, and fewer than KINDS kinds of rows in them, can be above the limit.
    kinds = rows.join(F.broadcast(large), _KEY).groupBy(*_KEY, "__hash").agg(F.count(F.lit(1)).alias("__n"))
    kinds = materialise(kinds.where(F.col("__n") > limit), "mix-kinds")
    split = F.broadcast(kinds.select(*_KEY, "__hash", F.ceil(F.col("__n") / limit).alias("__parts")))
    dealt = rows.join(split, [*_KEY, "__hash"]).withColumn("__number", F.monotonically_increasing_id())
    dealt = dealt.withColumns({"__kind": F.col("__hash"), "__part": F.pmod(F.xxhash64("__number"), F.col("__parts"))})
    names = [*rows.columns, "__kind", "__part"]
    dealt = materialise(dealt.select(*[F.col(f"`{c}`") for c in names]), "mix-equal-rows")
    others = rows.join(split, [*_KEY, "__hash"], "left_anti").select(*[F.col(f"`{c}`") for c in rows.columns]).withColumns(nought)
    parts = dealt.groupBy(*_PART).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    lost = parts.groupBy(*_KEY).agg(F.sum("n").alias("__n"), F.sum("words").alias("__words"))
    rest = cells.join(lost, _KEY, "left").select(
        *_KEY,
        *[value.alias(name) for name, value in nought.items()],
        (F.col("n") - F.coalesce("__n", F.lit(0))).alias("n"),
        (F.col("words") - F.coalesce("__words", F.lit(0))).alias("words"),
    )
    return others.unionByName(dealt), materialise(rest.unionByName(parts.select(*rest.columns)), "mix-cells")


def mix(
    docs: DataFrame,
    weights: DataFrame,
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (words, repeats counted).

    ``weights`` has columns source and weight, one row per source, as its author wrote it; of a source
    named twice the larger weight holds.
    """
    keep = [c for c in docs.columns if c.lower() not in RESULTS]
    order = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in keep if _hashable(docs, c)])
    size = word_count(F.col(f"`{text}`"))
    rows = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        size.alias("size"),
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("__src"),
        F.col(f"`{source}`").isNull().alias("__none"),
        order.alias("__hash"),
    ).withColumns({"__class": size_class(F.col("size")), "__cell": F.pmod(F.col("__hash"), F.lit(CELLS)).cast("int")})

    cells = materialise(
        rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mix-cells"
    )
    rows, cells = _split_equal(rows, cells)
    wanted = weights.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__src"),
        F.col("source").isNull().alias("__none"),
        "weight",
    ).groupBy("__src", "__none").agg(F.max("weight").alias("weight"))
    sizes = cells.groupBy("__src", "__none").agg(F.sum("words").alias("source_size"))
    classes = cells.groupBy("__src", "__none", "__class").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("__src", "__none").orderBy(F.desc("__class")).rowsBetween(Window.unboundedPreceding, -1)
    within = (
        Window.partitionBy("__src", "__none", "__class")
        .orderBy("__cell", "__kind", "__part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    class_starts = classes.select(
        "__src", "__none", "__class", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__class_start")
    )
    starts = (
        cells.select(*_PART, F.coalesce(F.sum("n").over(within), F.lit(0)).alias("__cell_start"))
        .join(class_starts, ["__src", "__none", "__class"])
        .join(targets(sizes, wanted, share, cap), ["__src", "__none"])
        .select(*_PART, (F.col("__class_start") + F.col("__cell_start")).alias("__start"), "source_size", "target")
    )
    number = F.row_number().over(Window.partitionBy(*_PART).orderBy("__hash"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64(F.lit(seed), "__src", "__none"), F.lit(_OFFSET_STEPS)) / F.lit(float(_OFFSET_STEPS))
    place = F.col("__start") + F.col("__number")
    crossed = F.floor(rate * place + offset) - F.floor(rate * (place - 1) + offset)
    return (
        rows.join(starts, _PART)
        .withColumn("__number", number)
        .withColumn("copies", F.least(crossed, F.ceil(rate)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*[F.col(f"`{c}`") for c in keep], *RESULTS)
    )


def emit(mixed: DataFrame) -> DataFrame:
    """Every row of ``mix`` as often as it was drawn."""
    return mixed.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def cycled_weights(docs: DataFrame, cycle: tuple[float, ...] = (3, 1, 2), source: str = "source") -> DataFrame:
    """Weights for the sources there are, in code-point order with null last, repeating ``cycle``."""
    names = docs.select(F.col(f"`{source}`").alias("source")).distinct()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    picked = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), F.pmod(place, F.lit(len(cycle))) + 1)
    return names.select("source", picked.alias("weight"))


def _hashable(docs: DataFrame, column: str) -> bool:
    """Maps and variants have no hash."""
    kind = docs.schema[column].dataType.simpleString()
    return "map<" not in kind and "variant" not in kind
