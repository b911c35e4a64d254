"""Certified fusion against the fusion of whole lists."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.config import Bm25Config, DenseConfig, HybridConfig
from rankloom.operators import encoding
from rankloom.operators.certified import certified_top_k
from rankloom.operators.fusion import rrf_top_k
from rankloom.operators.retrievers import Bm25Retriever, DenseRetriever
from rankloom.sources import indexes


class Listed:
    """A retriever that reads ranked lists from a table, and notes what it was asked."""

    def __init__(self, rows):
        self.rows, self.asked = rows, []

    def retrieve(self, queries, k):
        self.asked.append((queries.count(), k))
        return self.rows.join(queries.select("qid"), "qid", "left_semi").where(F.col("rank") <= k)


@pytest.fixture(scope="module")
def lists(spark):
    def build(seed, queries, docs, share):
        source = random.Random(seed)
        rows = []
        for q in range(queries):
            shown = source.sample(range(docs), int(docs * share * source.random()))
            rows += [(f"q{q}", f"d{d}", float(-n), n + 1) for n, d in enumerate(shown)]
        return spark.createDataFrame(rows, "qid string, doc_id string, score double, rank int")

    return build


def ranked(run):
    return sorted((r.qid, r["rank"], r.doc_id, round(r.score, 12)) for r in run.collect())


@pytest.mark.parametrize("config", [HybridConfig(), HybridConfig(bm25_weight=5.0), HybridConfig(rrf_k=1, over_fetch=1)])
@pytest.mark.parametrize("k", [1, 5, 40])
def test_same_as_whole_lists(spark, lists, config, k):
    asked = spark.createDataFrame([(f"q{n}", "") for n in range(25)], "qid string, text string")
    whole = {"bm25": lists(1, 24, 300, 1.0), "dense": lists(2, 24, 300, 1.0)}
    sides = {name: Listed(rows) for name, rows in whole.items()}
    found = certified_top_k(sides, asked, k, config)
    assert ranked(found.run) == ranked(rrf_top_k(whole, k, config))
    rounds = {r.qid: (r.rounds, r.depth) for r in found.rounds.collect()}
    assert len(rounds) == 25 and rounds["q24"][0] == 1  # nothing found anywhere
    depths = [k for _, k in sides["bm25"].asked]
    assert depths == [config.fetch_depth(k) * 4**n for n in range(len(depths))]
    counts = [n for n, _ in sides["bm25"].asked]
    assert counts == sorted(counts, reverse=True) and max(r for r, _ in rounds.values()) == len(depths)


def test_agreeing_lists_need_one_round(spark, make_run):
    lists = {name: make_run({"a": [f"d{n:04d}" for n in range(2000)]}) for name in ("bm25", "dense")}
    asked = spark.createDataFrame([("a", "")], "qid string, text string")
    found = certified_top_k({name: Listed(rows) for name, rows in lists.items()}, asked, 10)
    assert [(r.rounds, r.depth) for r in found.rounds.collect()] == [(1, 20)]
    assert ranked(found.run) == ranked(rrf_top_k(lists, 10))


def test_a_document_below_both_cuts_is_found(spark, make_run):
    """It stands third in both lists, behind others that only one of them knows."""
    lists = {"bm25": make_run({"a": ["x1", "x2", "both", "x3"]}), "dense": make_run({"a": ["y1", "y2", "both", "y3"]})}
    asked = spark.createDataFrame([("a", "")], "qid string, text string")
    config = HybridConfig(over_fetch=1)
    cut = {name: rows.where("rank <= 1") for name, rows in lists.items()}
    assert rrf_top_k(cut, 1, config).first().doc_id == "x1"
    found = certified_top_k({name: Listed(rows) for name, rows in lists.items()}, asked, 1, config, growth=2)
    assert found.run.first().doc_id == "both" and found.rounds.first().rounds > 1


def test_refusals_and_no_queries(spark, make_run):
    lists = {name: Listed(make_run({"a": ["x"]})) for name in ("bm25", "dense")}
    none = spark.createDataFrame([], "qid string, text string")
    found = certified_top_k(lists, none, 3)
    assert found.run.collect() == [] and found.rounds.collect() == []
    with pytest.raises(ValueError, match="growth is 1"):
        certified_top_k(lists, none, 3, growth=1)
    with pytest.raises(ValueError, match="no fusion weight"):
        certified_top_k({"other": lists["bm25"]}, none, 3)


def test_places_are_asked_for_instead_of_deep_lists(spark, tmp_path, monkeypatch):
    """Documents that lead one list and stand far down the other: the run of whole lists, from shallow ones."""
    source = random.Random(5)
    words = [f"w{n}" for n in range(60)]
    # Every third text is there twice, so that scores tie.
    texts = [" ".join(source.choices(words, k=source.randint(1, 30))) for _ in range(450)]
    texts += texts[::3]
    corpus = spark.createDataFrame([(n, t.split()[0], t) for n, t in enumerate(texts)], "doc_id long, title string, text string")
    corpus = corpus.withColumn("doc_id", F.col("doc_id").cast("string")).repartition(5)
    asked = [(n, " ".join(source.choices(words, k=6))) for n in range(12)] + [(12, "unknown"), (13, "")]
    asked = spark.createDataFrame(asked, "qid long, text string")
    index = indexes.write_text_index(spark, corpus, str(tmp_path / "index"))
    indexes.write_vectors(encoding.hash_documents(index, corpus, DenseConfig(dim=16)).repartition(4), f"{tmp_path}/vectors")
    vectors = indexes.load_vectors(spark, f"{tmp_path}/vectors")
    sides = {
        "bm25": Bm25Retriever(index),
        "dense": DenseRetriever(vectors, lambda rows: encoding.hash_queries(index, rows, DenseConfig(dim=16))),
    }
    expected = ranked(rrf_top_k({name: side.retrieve(asked, len(texts)) for name, side in sides.items()}, 5))
    depths = []
    for kind in (Bm25Retriever, DenseRetriever):
        real = kind.retrieve
        monkeypatch.setattr(kind, "retrieve", lambda self, q, k, real=real: depths.append(k) or real(self, q, k))
    assert ranked(certified_top_k(sides, asked, 5).run) == expected
    assert max(depths) <= 160 < len(texts)
