import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.config import DenseConfig
from rankloom.functions.vectors import inner_product, l2_normalize
from rankloom.operators.dense import check_dimensions, cosine_top_k, dense_top_k, mismatches
from rankloom.operators.encoding import encode, hash_documents, hash_queries
from rankloom.operators.lexical import index_corpus
from rankloom.operators.retrievers import DenseRetriever

SLICED = DenseConfig(broadcast_bytes=2000)


def frame(spark, key, matrix, ids=None, id_type="long"):
    rows = [(i if ids is None else ids[i], [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} {id_type}, embedding array<float>")


def brute_force(queries, vectors, k):
    q, v = (np.asarray(m, dtype=np.float32).astype(np.float64) for m in (queries, vectors))
    scores = (q @ v.T).astype(np.float32)
    out = []
    for i, row in enumerate(scores):
        order = sorted(range(len(row)), key=lambda j: (-row[j], j))[:k]
        out += [(i, j, place + 1) for place, j in enumerate(order)]
    return out


def places(run):
    return sorted((r.qid, r.doc_id, r["rank"]) for r in run.collect())


@pytest.mark.parametrize("config", [DenseConfig(), SLICED], ids=["once", "sliced"])
@pytest.mark.parametrize("partitions", [1, 6])
def test_agrees_with_brute_force(spark, config, partitions):
    rng = np.random.default_rng(0)
    queries, vectors = rng.normal(size=(23, 16)), rng.normal(size=(400, 16))
    run = dense_top_k(
        frame(spark, "qid", queries), frame(spark, "doc_id", vectors).repartition(partitions), 7, config
    )
    assert places(run) == sorted(brute_force(queries, vectors, 7))


@pytest.mark.parametrize("config", [DenseConfig(), SLICED], ids=["once", "sliced"])
def test_a_third_of_the_vectors_equal(spark, config):
    """Copies tie; the smaller ids win, however the copies are spread."""
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 8))
    vectors[::3] = np.ones(8)
    queries = np.vstack([np.ones((1, 8)), rng.normal(size=(4, 8))])
    run = dense_top_k(frame(spark, "qid", queries), frame(spark, "doc_id", vectors).repartition(5), 12, config)
    assert places(run) == sorted(brute_force(queries, vectors, 12))


def test_vectors_are_not_moved(spark, tmp_path):
    """The scan comes before the only shuffle, which carries k rows per query and partition."""
    path = str(tmp_path / "vectors")
    frame(spark, "doc_id", np.eye(8)).repartition(4).write.parquet(path)
    run = dense_top_k(frame(spark, "qid", np.eye(8)[:2]), spark.read.parquet(path), 3)
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(run._jdf.queryExecution(), "simple")
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1
    assert plan.index("Exchange") < plan.index("MapInArrow")
    assert "Partial" in plan[plan.index("Exchange") : plan.index("MapInArrow")]


def test_text_ids_sort_as_text(spark):
    ids = [f"d{i}" for i in range(20)]
    vectors = frame(spark, "doc_id", np.ones((20, 4)), ids, "string")
    run = dense_top_k(frame(spark, "qid", np.ones((1, 4)), ["q"], "string"), vectors.repartition(4), 5)
    assert [r.doc_id for r in run.orderBy("rank").collect()] == sorted(ids)[:5]


def test_k_above_the_number_of_vectors(spark):
    vectors = frame(spark, "doc_id", np.eye(3))
    run = dense_top_k(frame(spark, "qid", np.eye(3)[:1]), vectors, 10)
    assert run.count() == 3


@pytest.mark.parametrize("config", [DenseConfig(), SLICED], ids=["once", "sliced"])
def test_empty_sides(spark, config):
    some, none = np.eye(3), np.zeros((0, 3))
    assert dense_top_k(frame(spark, "qid", some), frame(spark, "doc_id", none), 5, config).count() == 0
    assert dense_top_k(frame(spark, "qid", none), frame(spark, "doc_id", some), 5, config).count() == 0


def test_vectors_that_are_no_numbers_are_not_found(spark):
    """However many there are and wherever they lie, k good ones come back."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(500, 8))
    bad = vectors.copy()
    bad[100:140, 3], bad[300:310, 1] = np.nan, np.inf
    queries = rng.normal(size=(3, 8))
    good = [k for k in range(500) if np.isfinite(bad[k]).all()]
    run = dense_top_k(frame(spark, "qid", queries), frame(spark, "doc_id", bad).coalesce(1), 10)
    expected = [(q, good[j], place) for q, j, place in brute_force(queries, vectors[good], 10)]
    assert places(run) == sorted(expected)


def test_an_empty_index_fetches_nothing(spark, monkeypatch):
    """Many queries against no vectors: no query vector comes to the driver."""
    from rankloom.operators import dense

    monkeypatch.setattr(dense, "_scan", lambda *_: pytest.fail("fetched"))
    queries = spark.range(100_000).selectExpr("id AS qid", "array(1.0f, 2.0f) AS embedding")
    assert dense_top_k(queries, frame(spark, "doc_id", np.zeros((0, 2))), 5).count() == 0


def test_more_queries_than_a_tile_and_more_vectors_than_a_block(spark, monkeypatch):
    from rankloom.operators import dense

    monkeypatch.setattr(dense, "_TILE_QUERIES", 7)
    monkeypatch.setattr(dense, "_BLOCK_VECTORS", 11)
    rng = np.random.default_rng(6)
    queries, vectors = rng.normal(size=(30, 4)), rng.integers(-1, 2, size=(200, 4))
    run = dense_top_k(frame(spark, "qid", queries), frame(spark, "doc_id", vectors).repartition(3), 9)
    assert places(run) == sorted(brute_force(queries, vectors, 9))


def test_cosine_and_zero_vector(spark):
    vectors = frame(spark, "doc_id", [[3.0, 4.0], [0.0, 0.0], [-1.0, 0.0]])
    got = {r.doc_id: r.score for r in cosine_top_k(frame(spark, "qid", [[2.0, 0.0]]), vectors, 3).collect()}
    assert got[0] == pytest.approx(0.6, abs=1e-7)
    assert got[1] == 0.0
    assert got[2] == pytest.approx(-1.0)


def test_native_expressions(spark):
    row = frame(spark, "id", [[3.0, 4.0]]).select(
        l2_normalize(F.col("embedding")).alias("unit"),
        inner_product(F.col("embedding"), F.col("embedding")).alias("ip"),
    ).first()
    assert row.unit == pytest.approx([0.6, 0.8])
    assert row.ip == 25.0


def test_dimension_mismatch(spark):
    index, queries = frame(spark, "doc_id", np.eye(3)), frame(spark, "qid", np.eye(4))
    with pytest.raises(ValueError, match=r"3 index vectors of dimension 3.*4 query vectors of dimension 4"):
        check_dimensions(index, queries)
    with pytest.raises(Exception, match="dimension"):
        dense_top_k(queries, index, 2).collect()
    check_dimensions(index, frame(spark, "qid", np.eye(3)))
    check_dimensions(index, frame(spark, "qid", np.zeros((0, 3))))


@pytest.mark.parametrize("k", [0, -1])
def test_k_must_be_positive(spark, k):
    vectors = frame(spark, "doc_id", np.eye(2))
    with pytest.raises(ValueError):
        dense_top_k(frame(spark, "qid", np.eye(2)), vectors, k)
    with pytest.raises(ValueError):
        DenseRetriever(vectors, lambda rows: rows).retrieve(vectors, k)


def test_encoder_hook(spark):
    """Any function from texts to a matrix will do; it sees at most a batch of texts at a time."""

    def encoder(texts):
        assert 0 < len(texts) <= 4
        return np.array([[len(t), t.count("a")] for t in texts], dtype=np.float32)

    texts = spark.createDataFrame([(i, "a" * i) for i in range(10)] + [(10, None)], "doc_id long, text string")
    raw = encode(texts.repartition(1), encoder, DenseConfig(batch_size=4, normalize=False))
    assert {r.doc_id: r.embedding for r in raw.collect()}[3] == [3.0, 3.0]
    unit = {r.doc_id: r.embedding for r in encode(texts, encoder, DenseConfig(batch_size=4)).collect()}
    assert unit[3] == pytest.approx([2**-0.5, 2**-0.5])
    assert unit[0] == [0.0, 0.0] and unit[10] == [0.0, 0.0]


def test_hashed_vectors(spark):
    corpus = spark.createDataFrame(
        [(1, "red fox", "red fox jumps"), (2, "", "blue whale"), (3, "", "")], "doc_id long, title string, text string"
    )
    index = index_corpus(corpus)
    config = DenseConfig(dim=64)
    docs = {r.doc_id: np.array(r.embedding) for r in hash_documents(index, corpus, config).collect()}
    assert {len(v) for v in docs.values()} == {64}
    assert np.linalg.norm(docs[1]) == pytest.approx(1.0, abs=1e-6)
    assert not docs[3].any()
    queries = spark.createDataFrame([("q", "fox"), ("none", "zebra")], "qid string, text string")
    asked = {r.qid: np.array(r.embedding) for r in hash_queries(index, queries, config).collect()}
    assert asked["q"] @ docs[1] > asked["q"] @ docs[2]
    assert not asked["none"].any()
    salted = hash_documents(index, corpus, DenseConfig(dim=64, broadcast_bytes=0))
    for row in salted.collect():
        assert row.embedding == pytest.approx(docs[row.doc_id], abs=1e-6)


def test_only_rows_of_rare_terms_are_moved(spark, monkeypatch):
    """Where the vocabulary does not fit, frequent terms are still broadcast; the vectors are the same."""
    from rankloom.operators import encoding

    corpus = spark.createDataFrame(
        [(n, f"all even{n % 2}", f"all of them own{n} own{n} {'few' if n < 3 else ''}") for n in range(40)]
        + [(40, "", ""), (41, "own41", "")],
        "doc_id long, title string, text string",
    )
    index = index_corpus(corpus)
    expected = {r.doc_id: np.array(r.embedding) for r in hash_documents(index, corpus, DenseConfig(dim=32)).collect()}
    moved = []
    real = encoding._rare_entries
    monkeypatch.setattr(encoding, "_rare_entries", lambda *a: moved.append(real(*a)) or moved[-1])
    found = hash_documents(index, corpus, DenseConfig(dim=32, broadcast_bytes=4000))
    for row in found.collect():
        assert row.embedding == pytest.approx(expected[row.doc_id], abs=1e-6)
    # The words of their own, one for each of 41 documents.
    assert moved[0].count() == 41
    assert found.count() == 42


def test_rows_that_do_not_fit_are_listed(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0]), (4, None)], "doc_id long, embedding array<float>")
    asked = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0, 3.0]), ("c", [])], "qid string, embedding array<float>")
    found = sorted(map(tuple, mismatches(vectors, asked).collect()))
    assert found == [("index", "3", 1, 2), ("index", "4", -1, 2), ("query", "b", 3, 2), ("query", "c", 0, 2)]


def test_places_beyond_every_partition_need_no_more_passes(spark, monkeypatch):
    """A k that no partition exceeds asks for no slices of its own: every score is passed on, none is kept."""
    from rankloom.operators import dense

    monkeypatch.setattr(dense, "_BLOCK_VECTORS", 16)
    passes = []
    real = dense._scan
    monkeypatch.setattr(dense, "_scan", lambda *a: passes.append(a) or real(*a))
    vectors = spark.createDataFrame(
        [(n, [float(n % 7), float(n % 3)]) for n in range(100)] + [(100, [float("nan"), 1.0])], "doc_id long, embedding array<float>"
    ).repartition(3)
    asked = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(20)], "qid long, embedding array<float>")
    run = dense.dense_top_k(asked, vectors, 101, DenseConfig(dim=2, broadcast_bytes=20 * 64 * 16))
    found = {}
    for r in run.collect():
        found.setdefault(r.qid, []).append((r["rank"], r.doc_id))
    assert len(passes) == 1
    for q in range(20):
        expected = sorted(range(100), key=lambda n: (-(n % 7 + q * (n % 3)), n))
        assert sorted(found[q]) == list(enumerate(expected, 1))


@pytest.mark.parametrize("limit", [64 << 20, 4000, 0])
@pytest.mark.parametrize("key", ["long", "string"])
def test_vectors_are_added_up_from_blocks(spark, tmp_path, limit, key):
    """A written index is read by its blocks: rows of postings are neither read nor grouped. The vectors are the same."""
    from rankloom.sources.indexes import write_text_index

    corpus = spark.createDataFrame(
        [(n, f"all even{n % 2}", f"all of them own{n} own{n} {'few' if n < 3 else ''}") for n in range(300)]
        + [(900, "", ""), (901, "own41", None), (902, None, None)],
        "doc_id long, title string, text string",
    ).withColumn("doc_id", F.col("doc_id").cast(key))
    # Owners may repeat, have no id, or not be in the index, and not all of the index are asked for.
    owners = corpus.where("doc_id <> 7").select("doc_id").union(spark.createDataFrame([("5",), (None,), ("77777",)], "doc_id string"))
    owners = owners.select(F.col("doc_id").cast(key).alias("doc_id"))
    config = DenseConfig(dim=32, broadcast_bytes=limit)
    expected = hash_documents(index_corpus(corpus), owners, DenseConfig(dim=32))
    written = write_text_index(spark, corpus, str(tmp_path / "index"), 3)
    found = hash_documents(written, owners, config)
    pairs = zip(*(sorted(frame.collect(), key=lambda r: str(r.doc_id)) for frame in (found, expected)), strict=True)
    for row, wanted in pairs:
        assert row.doc_id == wanted.doc_id and row.embedding == pytest.approx(wanted.embedding, abs=1e-6)
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert "rankloom_postings_blocks_" in plan and not re.search(r"rankloom_postings_(?!blocks)", plan)
