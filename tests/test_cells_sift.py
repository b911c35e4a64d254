"""Pairs of a cell are sifted in single precision; the run is that of double products."""

import numpy as np
import pyarrow as pa
import pytest

from rankloom.operators import cells
from rankloom.operators.dense import dense_top_k


def frame(spark, rows, key):
    return spark.createDataFrame([(n, [float(x) for x in row]) for n, row in enumerate(rows)], f"{key} long, embedding array<float>")


def ranked(run):
    return sorted((r.qid, r["rank"], r.doc_id, float(np.float32(r.score))) for r in run.collect())


def test_few_pairs_are_scored_in_double(spark, tmp_path, monkeypatch):
    """Once a query has k of the first vectors, the rest of a cell costs it little but products in single precision."""
    random = np.random.default_rng(1)
    rows = random.normal(size=(6000, 8)).astype(np.float32)
    asked = random.normal(size=(700, 8))
    index = cells.write_cells(spark, frame(spark, rows, "doc_id").coalesce(1), str(tmp_path / "cells"), cells=1)
    formed = []

    class Seen(cells._Best):
        def add(self, ids, scores):
            formed.append(scores.size)
            super().add(ids, scores)

    monkeypatch.setattr(cells, "_Best", Seen)
    made = []
    monkeypatch.setattr(type(index.vectors), "mapInArrow", lambda self, run, schema: made.append((self, run)) or self)
    cells._scan(index, pa.array(range(len(asked))), asked, np.ones((len(asked), 1), bool), np.full(len(asked), -np.inf), 3, None)
    found = pa.Table.from_batches(list(made[0][1](iter(made[0][0].toArrow().to_batches()))))
    assert sum(formed) < 0.3 * len(rows) * len(asked)
    # All three of every query, with the scores of double products.
    best = -np.sort(-(asked @ rows.astype(float).T), axis=1)[:, :3]
    assert found.num_rows == best.size
    mine = found.sort_by([("qid", "ascending"), ("score", "descending")])["score"].to_numpy().reshape(best.shape)
    assert np.allclose(mine, best, rtol=1e-14, atol=0)


@pytest.mark.parametrize("scale", [1e-30, 1.0, 1e18, 1e30])
@pytest.mark.parametrize("k", [1, 7, 600])
def test_scores_that_single_precision_cannot_tell_apart(spark, tmp_path, scale, k):
    """Vectors that differ in their last places and scores too small or too large for a single number."""
    random = np.random.default_rng(2)
    near = np.repeat(random.normal(size=(2, 16)), 1500, axis=0) * (1 + random.integers(-4, 5, size=(3000, 16)) * 2.0**-23)
    rows = (np.vstack([near, -near[:40], np.zeros((2, 16))]) * scale).astype(np.float32)
    vectors = frame(spark, rows, "doc_id")
    asked = frame(spark, np.vstack([rows[::400], np.zeros((1, 16)), [[np.nan] * 16, [np.inf] * 16]]), "qid")
    index = cells.write_cells(spark, vectors, str(tmp_path / "cells"), cells=3)
    mine, all_pairs = ranked(cells.cell_top_k(asked, index, k).run), ranked(dense_top_k(asked, vectors, k))
    assert len(mine) == len(all_pairs) == 9 * k
    # Sums in another order may differ by one place of a single number.
    assert [r[:2] for r in mine] == [r[:2] for r in all_pairs]
    assert np.allclose([r[3] for r in mine], [r[3] for r in all_pairs], rtol=2e-7, atol=0)


def test_shares_of_the_queries_and_ids_that_repeat(spark, tmp_path, monkeypatch):
    random = np.random.default_rng(3)
    rows = random.normal(size=(2500, 6)).astype(np.float32)
    vectors = frame(spark, rows, "doc_id")
    index = cells.write_cells(spark, vectors, str(tmp_path / "cells"), cells=9)
    asked = frame(spark, random.normal(size=(60, 6)), "qid")
    asked = asked.unionByName(asked.selectExpr("qid div 2 as qid", "embedding"))
    once = cells.cell_top_k(asked, index, 5)
    monkeypatch.setattr(cells, "_PAIRS", 20_000)
    dealt = cells.cell_top_k(asked, index, 5)
    assert ranked(dealt.run) == ranked(once.run) == ranked(dense_top_k(asked, vectors, 5))
    assert dealt.looked_at == once.looked_at
