"""Second-stage ranking and batches by length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.config import DenseConfig
from rankloom.operators import encoding, rerank


@pytest.fixture(scope="module")
def lengths():
    """A scorer that workers get as it is, since they cannot import the tests."""
    return lambda queries, texts: np.array([len(t) - len(q) for q, t in zip(queries, texts, strict=True)], float)


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rows = spark.range(200).selectExpr("concat('d', id) AS doc_id", "repeat('x', cast(id % 37 AS int)) AS text")
    return rerank.write_texts(spark, rows, str(tmp_path_factory.mktemp("texts") / "t"), buckets=5)


def test_ranked_by_the_scorer_ties_in_the_order_of_the_run(spark, texts, make_run, lengths):
    lists = {"a": ["d3", "d40", "d36", "d77", "none"], "b": ["d1"], "c": ["d5"]}
    asked = spark.createDataFrame([("a", ""), ("b", "qq"), ("z", "")], "qid string, text string")
    for batch in (1, 2, 64):
        run = rerank.rerank_top_k(make_run(lists), asked, texts, lengths, 4, batch)
        found = {(r.qid, r["rank"]): (r.doc_id, r.score) for r in run.collect()}
        assert found == {
            ("a", 1): ("d36", 36.0),
            ("a", 2): ("d3", 3.0),
            ("a", 3): ("d40", 3.0),
            ("a", 4): ("d77", 3.0),
            ("b", 1): ("d1", -1.0),
        }


def test_texts_stay_where_they_are(spark, texts, make_run, lengths):
    asked = spark.createDataFrame([("a", "q")], "qid string, text string")
    run = rerank.rerank_top_k(make_run({"a": ["d3", "d4"]}), asked, texts, lengths, 1)
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(run._jdf.queryExecution(), "simple")
    lines = plan.splitlines()
    scan = next(n for n, line in enumerate(lines) if "rankloom_texts" in line)
    indent = lines[scan].index("FileScan")
    above = [line for line in lines[:scan] if len(line) - len(line.lstrip(" :+-|")) < indent]
    parents = []
    for line in reversed(above):
        depth = len(line) - len(line.lstrip(" :+-|"))
        if depth < indent:
            parents.append(line)
            indent = depth
    joined = next(n for n, line in enumerate(parents) if "HashJoin" in line)
    assert not any("Exchange" in line or "Sort" in line for line in parents[:joined])


def test_opened_again_and_as_a_retriever(spark, tmp_path, make_run, lengths):
    rows = spark.createDataFrame([(1, "long text"), (2, "text"), (3, None)], "doc_id long, text string")
    written = rerank.write_texts(spark, rows, str(tmp_path / "t"), buckets=3)
    opened = rerank.load_texts(spark, str(tmp_path / "t"), "bigint", written.buckets)
    run = spark.createDataFrame([("q", d, 1.0, n) for n, d in enumerate((3, 2, 1), 1)], "qid string, doc_id long, score double, rank int")

    class Fixed:
        def retrieve(self, queries, k):
            return run.where(F.col("rank") <= k)

    asked = spark.createDataFrame([("q", "")], "qid string, text string")
    for depth, expected in ((1, [2, 3]), (3, [1, 2])):
        found = rerank.RerankedRetriever(Fixed(), opened, lengths, depth).retrieve(asked, 2)
        assert [r.doc_id for r in found.orderBy("rank").collect()] == expected


def test_a_scorer_with_too_few_scores_is_refused(spark, texts, make_run):
    asked = spark.createDataFrame([("a", "q")], "qid string, text string")
    run = rerank.rerank_top_k(make_run({"a": ["d3", "d4"]}), asked, texts, lambda q, t: np.zeros(2), 1)
    with pytest.raises(Exception, match="the scorer gave"):
        run.collect()


def test_batches_are_within_the_budget():
    source = np.random.default_rng(1)
    sizes = [int(n) for n in source.zipf(1.6, 3000) % 900] + [0, 0, 5000]
    batches = encoding.like_length_batches(sizes, 2000, 64)
    assert sorted(n for b in batches for n in b) == list(range(len(sizes)))
    assert all(len(b) <= 64 and (len(b) == 1 or max(sizes[n] for n in b) * len(b) <= 2000) for b in batches)
    padding = sum(max(sizes[n] for n in b) * len(b) - sum(sizes[n] for n in b) for b in batches)
    plain = [range(start, min(start + 64, len(sizes))) for start in range(0, len(sizes), 64)]
    before = sum(max(sizes[n] for n in b) * len(b) - sum(sizes[n] for n in b) for b in plain)
    assert padding < 0.1 * sum(sizes) < before


def test_encoded_by_length_in_the_order_of_the_rows(spark, monkeypatch):
    rows = [(n, "ab" * (n * 7919 % 50)) for n in range(500)] + [(500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(encoding, "WAITING_TEXTS", 90)

    def shares(texts):
        return np.array([[t.count("a"), t.count("b"), 1] for t in texts])

    config = DenseConfig(batch_size=8)
    plain = [(r.doc_id, r.embedding) for r in encoding.encode(docs, shares, config).collect()]
    assert [(r.doc_id, r.embedding) for r in encoding.encode_by_length(docs, shares, 300, config).collect()] == plain
    assert encoding.encode_by_length(docs.limit(0), shares, 300).collect() == []
