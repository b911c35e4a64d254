import numpy as np
import pytest

from rankloom.llm import embedding_dedup as dedup
from rankloom.llm.embedding_dedup import Settings

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """Links and components by comparing everything within a label, in double precision."""
    ids = [r[0] for r in rows]
    unit = []
    for _, vector, label in rows:
        v = np.array(vector, dtype=np.float64)
        unit.append(v / np.linalg.norm(v))
    unit, labels = np.array(unit), np.array([r[2] for r in rows])
    close = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(close, False)
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in np.argwhere(close):
        x, y = sorted((root(a), root(b)), key=lambda k: ids[k])
        parent[y] = x
    return {ids[k]: (int(close[k].sum()), ids[root(k)]) for k in range(len(rows))}


def clustered(n, seed, dims=64, copies=5, noise=0.012):
    random = np.random.default_rng(seed)
    rows, base = [], None
    for k in range(n):
        if k % copies == 0:
            base = random.normal(size=dims)
            base /= np.linalg.norm(base)
        vector = (base + random.normal(size=dims) * noise * random.uniform(0.2, 2)).astype(np.float32)
        rows.append((int(random.permutation(1)[0]) + 7 * k % 100_003, vector.tolist(), int(k // copies) % 2))
    return rows


@pytest.mark.parametrize(
    "settings",
    [
        Settings(),
        Settings(cell_rows=200, sample=1500, block_rows=90, tile=32),
        Settings(cell_rows=100, max_cells=9, block_rows=64, tile=50),
    ],
)
def test_recall_against_brute_force(spark, settings):
    rows = clustered(2400, 1)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = {r.vec_id: (r.n_links, r.component_id) for r in dedup.link(frame, settings).collect()}
    right = brute(rows)
    assert found.keys() == right.keys()
    assert sum(n for n, _ in found.values()) >= 0.99 * sum(n for n, _ in right.values())
    assert all(found[k][0] <= right[k][0] for k in right)
    assert sum(found[k] == right[k] for k in right) >= 0.99 * len(right)


def test_without_margin_nothing_is_lost(spark):
    rows = clustered(1200, 2, dims=8)
    frame = spark.createDataFrame(rows, SCHEMA)
    settings = Settings(cell_rows=100, block_rows=70, margin=None)
    found = {r.vec_id: (r.n_links, r.component_id) for r in dedup.link(frame, settings).collect()}
    assert found == brute(rows)


def test_one_large_group(spark):
    """A third of all rows are near copies of one vector; blocks share the work."""
    random = np.random.default_rng(3)
    base = random.normal(size=16)
    rows = [(k, (base + random.normal(size=16) * 0.001 if k % 3 == 0 else random.normal(size=16)).tolist(), 1) for k in range(900)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in dedup.link(frame, Settings(block_rows=64)).collect()}
    right = brute([(k, np.array(v, np.float32), label) for k, v, label in rows])
    assert {k: v[:2] for k, v in found.items()} == right
    assert all(v[2] == (v[1] == k) for k, v in found.items())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [1.0, 2.0, 3.0]
    rows = [
        (1, good, 1, "x"), (2, [2.0, 4.0, 6.0], 1, "x"), (3, good, 2, "x"), (4, good, None, "x"), (5, None, 1, "x"),
        (6, [], 1, "x"), (7, [0.0, 0.0, 0.0], 1, "x"), (8, [1.0, None, 3.0], 1, "x"), (9, [1.0, nan, 3.0], 1, "x"),
        (10, [inf, 2.0, 3.0], 1, "x"), (11, [1.0, 2.0], 1, "x"), (12, [1e-30, 2e-30, 3e-30], 1, "x"),
        (13, [1e30, 2e30, 3e30], 1, "x"), (13, [1e30, 2e30, 3e30], 1, "x"), (None, good, 1, "x"),
    ]
    frame = spark.createDataFrame(rows, SCHEMA + ", N_LINKS string")
    found = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in dedup.link(frame).collect()]
    assert len(found) == len(rows)
    linked = {1, 2, 12, 13}
    for vec_id, links, component, kept in found:
        if vec_id in linked:
            assert (links, component, kept) == (3, 1, vec_id == 1)
        else:
            assert (links, component, kept) == (0, vec_id, True)
    assert dedup.link(frame.limit(0)).collect() == []


@pytest.mark.parametrize("settings", [Settings(cell_rows=20), Settings(cell_rows=20, block_rows=25, tile=16)])
def test_nothing_is_lost_where_copies_differ_in_few_directions(spark, settings):
    """Vectors of 768 numbers that lie in a few directions, in many cells."""
    random = np.random.default_rng(6)
    frame = np.linalg.qr(random.normal(size=(768, 6)))[0]
    rows = []
    for k in range(1500):
        if k % 5 == 0:
            base = random.normal(size=6)
            base /= np.linalg.norm(base)
        step = random.normal(size=6) * (1.0, 0.7, 0.5, 0.1, 0.1, 0.1)
        rows.append((k * 7919 % 1500, ((base + step * 0.08) @ frame.T).astype(np.float32).tolist(), 1))
    found = {r.vec_id: (r.n_links, r.component_id) for r in dedup.link(spark.createDataFrame(rows, SCHEMA), settings).collect()}
    assert found == brute(rows)


def test_repeated_ids_link_by_each_of_their_rows(spark):
    a, b, c = [1.0, 2.0, 3.0], [3.0, -1.0, 1.0], [-2.0, 1.0, 4.0]
    rows = [(1, a, 1), (5, a, None), (5, None, 1), (5, [0.0, 0.0, 0.0], 0), (5, a, 1), (5, a, 1), (5, b, 2), (3, b, 2), (8, c, 1)]
    found = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in dedup.link(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(found) == [(1, 1, 1, True), (3, 1, 1, False)] + [(5, 2, 1, False)] * 6 + [(8, 0, 8, True)]
