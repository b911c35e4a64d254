"""Search over cells against the scan of all vectors."""

import numpy as np
import pytest

from rankloom.config import DenseConfig
from rankloom.operators import cells
from rankloom.operators.dense import dense_top_k

VECTORS = "doc_id long, embedding array<float>"


def frame(spark, rows, key="doc_id", start=0):
    return spark.createDataFrame(
        [(start + n, [float(x) for x in row]) for n, row in enumerate(rows)], VECTORS.replace("doc_id", key)
    )


def ranked(run):
    return sorted((r.qid, r["rank"], r.doc_id, round(r.score, 5)) for r in run.collect())


def clustered(seed, n, dim=12, groups=20):
    random = np.random.default_rng(seed)
    middle = random.normal(size=(groups, dim)) * 4
    return (middle[random.integers(0, groups, n)] + random.normal(size=(n, dim)) * 0.3).astype(np.float32)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = np.vstack([clustered(1, 3000), np.repeat(clustered(2, 1), 300, axis=0), np.zeros((3, 12), np.float32)])
    vectors = frame(spark, rows).repartition(5)
    return vectors, cells.write_cells(spark, vectors, str(tmp_path_factory.mktemp("cells") / "index"), cells=40)


@pytest.mark.parametrize("k", [1, 10, 400, 5000])
def test_the_run_is_exact(spark, index, k):
    vectors, found = index
    asked = frame(spark, np.vstack([clustered(3, 25), -clustered(4, 5), np.zeros((1, 12))]), "qid")
    assert ranked(cells.cell_top_k(asked, found, k).run) == ranked(dense_top_k(asked, vectors, k))


def test_most_cells_are_skipped_where_vectors_form_groups(spark, index):
    vectors, found = index
    asked = frame(spark, clustered(1, 40), "qid")
    result = cells.cell_top_k(asked, found, 10)
    assert result.pairs == 40 * len(found.cells) and result.skipped > 0.6
    assert ranked(result.run) == ranked(dense_top_k(asked, vectors, 10))


def test_cells_hold_all_vectors_within_their_radius(index):
    vectors, found = index
    rows = {r.doc_id: (r.cell, np.array(r.embedding)) for r in found.vectors.collect()}
    assert len(rows) == vectors.count() == found.counts.sum()
    place = {int(c): n for n, c in enumerate(found.cells)}
    for cell, row in rows.values():
        gap = np.linalg.norm(row - found.centres[place[cell]])
        assert gap <= found.radii[place[cell]] * (1 + 1e-9) + 1e-12
        assert gap <= np.linalg.norm(row - found.centres, axis=1).min() + 1e-5


def test_probes_and_recall(spark, index):
    vectors, found = index
    asked = frame(spark, clustered(5, 40, groups=20), "qid")
    exact = dense_top_k(asked, vectors, 10)
    shares = []
    for probes in (1, 5, len(found.cells)):
        result = cells.cell_top_k(asked, found, 10, probes)
        row = cells.recall(result.run, exact).first()
        assert row.queries == 40 and row.found == round(row.recall * 400) and result.looked_at == 40 * probes
        shares.append(row.recall)
    assert shares == sorted(shares) and shares[-1] == 1.0


def test_unread_cells_are_not_in_the_plan(spark, index):
    vectors, found = index
    plan_of = spark.sparkContext._jvm.PythonSQLUtils.explainString
    run = cells.cell_top_k(frame(spark, clustered(1, 1), "qid"), found, 1, probes=1).run
    pruned = plan_of(run._jdf.queryExecution(), "formatted").split("PartitionFilters: [")[1].split("]")[0]
    assert "cell#" in pruned
    assert "Exchange rangepartitioning" not in plan_of(run._jdf.queryExecution(), "simple")


def test_slices_text_ids_and_odd_vectors(spark, tmp_path):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [float("nan"), 1.0]), ("d", [float("inf"), 0.0]), ("e", [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "doc_id string, embedding array<float>")
    found = cells.write_cells(spark, vectors, str(tmp_path / "one"), cells=8)
    asked = spark.createDataFrame([(f"q{n}", [1.0, n / 7]) for n in range(9)], "qid string, embedding array<float>")
    small = cells.cell_top_k(asked, found, 2, config=DenseConfig(broadcast_bytes=400))
    assert ranked(small.run) == ranked(cells.cell_top_k(asked, found, 2).run) == ranked(dense_top_k(asked, vectors, 2))
    again = cells.load_cells(spark, str(tmp_path / "one"))
    assert ranked(cells.cell_top_k(asked, again, 2).run) == ranked(small.run)
    empty = cells.write_cells(spark, vectors.limit(0), str(tmp_path / "two"))
    assert cells.cell_top_k(asked, empty, 3).run.collect() == []
    assert cells.cell_top_k(asked.limit(0), found, 3).run.collect() == []
    with pytest.raises(ValueError, match="dimension"):
        cells.cell_top_k(spark.createDataFrame([("q", [1.0])], "qid string, embedding array<float>"), found, 1)


def test_scores_are_formed_tile_by_tile(spark, tmp_path, monkeypatch):
    """However many queries want a cell, only a block of vectors by a tile of queries is scored at once."""
    shapes = []

    class Seen(cells._Best):
        def add(self, ids, scores):
            shapes.append(scores.shape)
            super().add(ids, scores)

    monkeypatch.setattr(cells, "_Best", Seen)
    rows = clustered(5, 1500)
    vectors = frame(spark, rows).coalesce(1)
    index = cells.write_cells(spark, vectors, str(tmp_path / "tiles"), cells=3)
    made = []
    monkeypatch.setattr(type(index.vectors), "mapInArrow", lambda self, run, schema: made.append((self, run)) or self)
    names = cells.pa.array(range(len(rows)))
    wanted = np.ones((len(rows), len(index.cells)), bool)
    cells._scan(index, names, rows.astype(float), wanted, np.full(len(rows), -np.inf), 4, None)
    scanned, run = made[0]
    found = cells.pa.Table.from_batches(list(run(iter(scanned.toArrow().to_batches()))))
    assert max(width for _, width in shapes) <= cells._TILE_QUERIES < len(rows)
    # At most k rows per query and cell, and the best of them are those of all scores.
    assert found.num_rows <= 4 * len(rows) * len(index.cells)
    best = found.group_by("qid").aggregate([("score", "max")]).sort_by("qid")["score_max"].to_numpy()
    assert np.allclose(best, (rows.astype(float) @ rows.astype(float).T).max(axis=1))
