import pytest

from rankloom.config import HybridConfig
from rankloom.operators.fusion import contributions, fuse, rrf_top_k
from rankloom.operators.retrievers import FusedRetriever, HybridRetriever


class Fixed:
    """A retriever that always gives the same run."""

    def __init__(self, run):
        self.run = run
        self.asked = []

    def retrieve(self, queries, k):
        self.asked.append(k)
        return self.run.where(self.run["rank"] <= k)


def ids(frame):
    return [row.doc_id for row in frame.orderBy("rank").collect()]


def test_document_of_both_sides_leads(make_run):
    runs = {"bm25": make_run({"q": ["d1", "d2"]}), "dense": make_run({"q": ["d2", "d3"]})}
    fused = ids(rrf_top_k(runs, 3))
    assert fused[0] == "d2"
    assert set(fused) == {"d1", "d2", "d3"}


def test_cut_at_k(make_run):
    docs = [f"d{i}" for i in range(5)]
    assert len(ids(rrf_top_k({"bm25": make_run({"q": docs}), "dense": make_run({"q": docs})}, 2))) == 2


@pytest.mark.parametrize("bm25, dense, leader", [(10.0, 0.1, "lexical"), (0.1, 10.0, "semantic")])
def test_weights(make_run, bm25, dense, leader):
    runs = {"bm25": make_run({"q": ["lexical"]}), "dense": make_run({"q": ["semantic"]})}
    assert ids(rrf_top_k(runs, 2, HybridConfig(bm25_weight=bm25, dense_weight=dense)))[0] == leader


def test_equal_scores_keep_the_order_of_the_sides(make_run):
    runs = {"bm25": make_run({"q": ["z", "y"]}), "dense": make_run({"q": ["a", "b"]})}
    assert ids(rrf_top_k(runs, 4)) == ["z", "a", "y", "b"]


def test_scores(make_run):
    runs = {"bm25": make_run({"q": ["d1", "d2"]}), "dense": make_run({"q": ["d2"]})}
    got = {r.doc_id: r for r in fuse(runs).collect()}
    assert got["d2"].score == pytest.approx(1 / 62 + 1 / 61)
    assert (got["d2"].bm25_rank, got["d2"].dense_rank) == (2, 1)
    assert (got["d1"].bm25_rank, got["d1"].dense_rank) == (1, None)


def test_three_runs(make_run):
    runs = {name: make_run({"q": [name, "shared"]}) for name in ("bm25", "dense", "other")}
    config = HybridConfig(more_weights=(("other", 1.0),))
    assert ids(rrf_top_k(runs, 2, config))[0] == "shared"
    assert contributions(runs, config).count() == 6


def test_depth_of_each_side(spark, make_run):
    run = make_run({"q": [f"d{i}" for i in range(300)]})
    bm25, dense = Fixed(run), Fixed(make_run({"q": [f"e{i}" for i in range(300)]}))
    queries = spark.createDataFrame([("q", "text")], "qid string, text string")
    hybrid = HybridRetriever(bm25, dense)
    assert len(ids(hybrid.retrieve(queries, 10))) == 10
    assert bm25.asked == [20] and dense.asked == [20]
    # Without a limit both sides are read as deep as they go.
    assert len(ids(hybrid.retrieve(queries, 250))) == 250
    assert bm25.asked == [20, 500]
    # A limit cuts what is read beyond k, never k itself.
    limited = HybridRetriever(bm25, dense, HybridConfig(max_fetch=100))
    assert len(ids(limited.retrieve(queries, 80))) == 80
    assert len(ids(limited.retrieve(queries, 250))) == 250
    assert bm25.asked == [20, 500, 100, 250]


def test_runs_are_fused_as_deep_as_given(make_run):
    runs = {"bm25": make_run({"q": [f"d{i}" for i in range(90)]}), "dense": make_run({"q": ["d89"]})}
    assert ids(rrf_top_k(runs, 1)) == ["d89"]


def test_any_retrievers_by_name(spark, make_run):
    queries = spark.createDataFrame([("q", "text")], "qid string, text string")
    sides = {name: Fixed(make_run({"q": docs})) for name, docs in (("bm25", ["a", "b"]), ("graph", ["b", "c"]))}
    heavy = HybridConfig(more_weights=(("graph", 9.0),))
    assert ids(FusedRetriever(sides, heavy).retrieve(queries, 3)) == ["b", "c", "a"]
    with pytest.raises(ValueError, match="no fusion weight for 'graph'"):
        FusedRetriever(sides).retrieve(queries, 3)


@pytest.mark.parametrize("k", [0, -1])
def test_k_must_be_positive(spark, make_run, k):
    run = make_run({"q": ["d"]})
    with pytest.raises(ValueError):
        rrf_top_k({"bm25": run, "dense": run}, k)
    with pytest.raises(ValueError):
        HybridRetriever(Fixed(run), Fixed(run)).retrieve(run, k)
