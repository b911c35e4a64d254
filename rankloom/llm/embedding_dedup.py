"""Near-duplicate embeddings by spherical k-means cells and blocked cosine products.

Vectors are only compared when their labels are equal. A label with many rows is cut into cells by
spherical k-means, fitted on a bounded sample; every vector is assigned to its nearest centre. A vector
is also a guest in other cells, where a linked vector may have its home: if x lives in cell c and y in
cell d, the line from x to y crosses the plane between both centres, so the distances of x and y to that
plane add up to |x - y| at most, and one of them is no more than half of it. Vectors within half the
largest |x - y| of a plane are guests beyond it, so at least one of both cells holds both vectors, and no
link is lost, in whatever directions vectors differ. ``margin`` can narrow that to so many standard
deviations of a difference spread over all dimensions, with fewer guests and without that guarantee.

Two residents of a cell are compared there. A resident and a guest are counted, for both ends, in the
smaller one of their home cells that holds both, so each link is counted once at either end. Large cells
are dealt into blocks and compared by pairs of blocks; a task multiplies matrices and gives one row per
vector with its number of links and the smallest linked id it knows. Components of those edges give the
groups; the smallest id of a group represents it.

Defined results: vectors that are null, empty, zero, or hold null or non-finite parts, and those without
label or id, link with nothing: no links, their own component, kept. Vectors of unequal length never
link. If an id is repeated, each of its distinct pairs of label and vector that can link takes part, whatever
its other rows hold; links with pairs of other ids are added up, and all rows of the id get that result. An
empty table gives an empty table. Only the named columns are read; others, whatever their names, do not come
along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankloom.llm.blocks import Forest
from rankloom.llm.common import slices
from rankloom.llm.components import components
from rankloom.session import materialise


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.98
    # Rows a cell should have; a label gets as many cells as that needs, within the bound below.
    cell_rows: int = 512
    # Centres of all labels together: bounds what is broadcast and kept by a worker.
    max_cells: int = 4096
    # Rows that k-means is fitted on, of all labels together.
    sample: int = 20_000
    rounds: int = 8
    # None loses nothing.
    margin: float | None = None
    # Rows of a block: two blocks of 64 numbers each are 16 MB.
    block_rows: int = 16_384
    # Rows of one side of a product.
    tile: int = 1024
    seed: int = 3


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """id, part (label and length) and vector, scaled to length one; distinct rows that can link."""
    parts = F.transform(F.col(f"`{embedding}`"), lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = (
        vectors.where(F.col(f"`{vec_id}`").isNotNull())
        .select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), parts.alias("vector"))
        .where(F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))
        .where(~F.exists("vector", bad))
        .distinct()
        # By the largest part first, so that squares neither overflow nor vanish.
        .withColumn("peak", F.array_max(F.transform("vector", F.abs)))
        .where("peak > 0")
        .withColumn("vector", F.transform("vector", lambda x: x / F.col("peak")))
        .withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))
    )
    part = F.concat_ws(" ", F.size("vector").cast("string"), F.col("label").cast("string"))
    return rows.select("id", part.alias("part"), F.transform("vector", lambda x: x / F.col("norm")).alias("vector"))


def fit_centres(rows: DataFrame, settings: Settings) -> dict[str, np.ndarray]:
    """Centres per part with more than ``cell_rows`` rows; the others are one cell.

    The parts that get centres are the largest, no more than ``max_cells`` / 2, as each has two or more.
    """
    large = rows.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > settings.cell_rows)
    sizes = {r["part"]: r["n"] for r in large.orderBy(F.desc("n"), "part").limit(settings.max_cells // 2).collect()}
    total = sum(sizes.values())
    if not sizes:
        return {}
    steps = 1 << 20
    near = F.pmod(F.xxhash64("id", F.lit(settings.seed)), F.lit(steps)) < int(steps * min(1.0, settings.sample / total))
    chosen = rows.where(F.col("part").isin(list(sizes)) & near).limit(2 * settings.sample).collect()
    by_part: dict[str, list] = {}
    for row in sorted(chosen, key=lambda r: r["id"]):
        by_part.setdefault(row["part"], []).append(row["vector"])
    wanted = {part: -(-n // settings.cell_rows) for part, n in sizes.items()}
    shrink = min(1.0, settings.max_cells / sum(wanted.values()))
    centres = {}
    for part, vectors in by_part.items():
        count = min(max(2, int(wanted[part] * shrink)), len(vectors))
        centres[part] = spherical_k_means(np.array(vectors), count, settings.rounds, settings.seed)
    return centres


def spherical_k_means(points: np.ndarray, count: int, rounds: int, seed: int) -> np.ndarray:
    """``count`` centres of length one for rows of length one."""
    random = np.random.default_rng(seed)
    centres = points[random.choice(len(points), count, replace=False)]
    for _ in range(rounds):
        home = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, points)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where((norms > 0)[:, None], sums / np.where(norms > 0, norms, 1)[:, None], centres)
    return centres


def memberships(vectors: np.ndarray, centres: np.ndarray, chord: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and whether the cell is the row's home, for homes and guests.

    ``chord`` is how far beyond the plane between two centres a row may lie to be a guest there.
    """
    products = vectors @ centres.T
    home = products.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))
    guest = products >= products[np.arange(len(home)), home][:, None] - chord * apart[home] - 1e-9
    guest[np.arange(len(home)), home] = True
    row, cell = np.nonzero(guest)
    return row, cell, cell == home[row]


def assign(rows: DataFrame, centres: dict[str, np.ndarray], settings: Settings) -> DataFrame:
    """id, cell, number, home, guest_in and vector: one row per vector and cell it belongs to.

    ``number`` is that of the cell within its part; ``guest_in`` has the numbers of a resident's other cells.
    """
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, 2048):
            parts = np.array(batch.column("part").to_pylist(), dtype=object)
            pick, cells, numbers, homes, guest_in = [], [], [], [], []
            for part in sorted(set(parts)):
                at = np.flatnonzero(parts == part)
                if part not in known:
                    pick.append(at)
                    cells += [f"{part} 0"] * len(at)
                    numbers.append(np.zeros(len(at), np.int32))
                    homes.append(np.zeros(len(at), np.int32))
                    guest_in += [None] * len(at)
                    continue
                vectors = _matrix(batch.column("vector").take(pa.array(at)))
                chord = np.sqrt(2 - 2 * settings.threshold)
                chord *= 0.5 if settings.margin is None else min(0.5, settings.margin / np.sqrt(vectors.shape[1]))
                row, cell, home = memberships(vectors, known[part], chord)
                starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                others = [c[~h] for c, h in zip(np.split(cell, starts[1:]), np.split(home, starts[1:]), strict=True)]
                pick.append(at[row])
                cells += [f"{part} {c}" for c in cell]
                numbers.append(cell.astype(np.int32))
                homes.append(cell[home][row].astype(np.int32))
                guest_in += [others[k] if h and len(others[k]) else None for k, h in zip(row, home, strict=True)]
            index = pa.array(np.concatenate(pick))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(index),
                    pa.array(cells, pa.string()),
                    pa.array(np.concatenate(numbers)),
                    pa.array(np.concatenate(homes)),
                    pa.array(guest_in, pa.list_(pa.int32())),
                    batch.column("vector").take(index),
                ],
                names=["id", "cell", "number", "home", "guest_in", "vector"],
            )

    return rows.mapInArrow(run, "id long, cell string, number int, home int, guest_in array<int>, vector array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _linked(unit: Unit, side: np.ndarray, other: np.ndarray, settings: Settings):
    """Per row, its links between ``side`` and ``other``, and the forest of links.

    Residents in ``other`` ask for themselves; a guest there is told of its links with ``side`` here.
    """
    ids, vectors = unit.ids, unit.vectors
    counts = np.zeros(len(ids), np.int64)
    forest = Forest(ids)
    for a in range(0, len(side), settings.tile):
        left = side[a : a + settings.tile]
        for b in range(0, len(other), settings.tile):
            right = other[b : b + settings.tile]
            close = vectors[left] @ vectors[right].T >= settings.threshold
            close &= ids[left][:, None] != ids[right][None, :]
            for k in np.flatnonzero(close.any(axis=1)):
                near = right[close[k]]
                # One find for rows that hang together already.
                forest.join(left[k], near[forest.parent[near] != forest.root(left[k])])
            guest = unit.home[right] != unit.number
            if guest.any():
                close[:, guest] &= unit.counted_here(left, right[guest])
                counts[right[guest]] += close[:, guest].sum(axis=0)
            counts[left] += close.sum(axis=1)
    return counts, forest.names()


@dataclass
class Unit:
    """Rows of a cell; ``number`` is the cell's, ``home`` and ``guest_in`` are as in ``assign``."""

    number: int
    ids: np.ndarray
    vectors: np.ndarray
    home: np.ndarray
    guest_in: list

    def counted_here(self, residents: np.ndarray, guests: np.ndarray) -> np.ndarray:
        """Whether this is the cell that counts a resident and a guest: the smaller home that holds both."""
        cells, column = np.unique(self.home[guests], return_inverse=True)
        there = np.zeros((len(residents), len(cells)), bool)
        for k, row in enumerate(residents):
            if self.guest_in[row] is not None:
                there[k] = np.isin(cells, self.guest_in[row])
        return ((self.number < cells) | ~there)[:, column]


def compare(members: DataFrame, settings: Settings) -> DataFrame:
    """id, links and least (the smallest id it hangs together with), for rows that have any.

    A resident asks all rows of its cell, itself apart; its guests hear of what they have in common. Where
    the cell has one block, each row comes once and residents ask all rows; else rows that ask and rows that are asked come apart, block by block.
    """
    sizes = members.groupBy("cell").agg(F.ceil(F.count("*") / settings.block_rows).cast("int").alias("blocks"))
    dealt = members.join(sizes, "cell").withColumn(
        "block", F.pmod(F.xxhash64("id", F.lit(settings.seed)), F.col("blocks")).cast("int")
    )

    def turn(left, right, asks):
        return F.struct(left.alias("left"), right.alias("right"), asks.alias("asks"))

    turns = F.sequence(F.lit(0), F.col("blocks") - 1)
    asking = F.transform(turns, lambda k: turn(F.col("block"), k, F.lit(True)))
    asked = F.transform(turns, lambda k: turn(k, F.col("block"), F.lit(False)))
    resident = F.col("home") == F.col("number")
    several = F.when(resident, F.concat(asking, asked)).otherwise(asked)
    once = F.array(turn(F.lit(0), F.lit(0), resident))
    units = dealt.withColumn("turn", F.explode(F.when(F.col("blocks") == 1, once).otherwise(several))).select(
        "cell",
        "turn.left",
        "turn.right",
        "turn.asks",
        (F.col("blocks") > 1).alias("apart"),
        "id",
        "number",
        "home",
        "guest_in",
        "vector",
    )

    def run(unit: pa.Table) -> pa.Table:
        ids = unit.column("id").to_numpy()
        asks = unit.column("asks").to_numpy()
        rows = Unit(
            unit.column("number")[0].as_py(),
            ids,
            _matrix(unit.column("vector").combine_chunks()),
            unit.column("home").to_numpy(),
            unit.column("guest_in").to_pylist(),
        )
        others = np.flatnonzero(~asks) if unit.column("apart")[0].as_py() else np.arange(len(ids))
        counts, least = _linked(rows, np.flatnonzero(asks), others, settings)
        told = (counts > 0) | (least != ids)
        return pa.table({"id": ids[told], "links": counts[told], "least": least[told]})

    return units.groupBy("cell", "left", "right").applyInArrow(run, "id long, links long, least long")


def link(
    vectors: DataFrame,
    settings: Settings = Settings(),
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id and kept; one row per row of ``vectors``."""
    rows = materialise(usable(vectors, vec_id, embedding, label), "unit-vectors")
    compared = materialise(compare(assign(rows, fit_centres(rows, settings), settings), settings), "vector-links")
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(compared.select(F.col("id").alias("u"), F.col("least").alias("v")), "vector-groups")
    ids = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"))
    return (
        ids.join(links, F.col("vec_id") == F.col("id"), "left")
        .drop("id")
        .join(groups, F.col("vec_id") == F.col("node"), "left")
        .select(
            "vec_id",
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
            (F.col("component").isNull() | (F.col("component") == F.col("vec_id"))).alias("kept"),
        )
    )
