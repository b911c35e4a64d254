"""Search over blocks with bounds: the run of the plain plan, at a part of its work."""

import random
from collections import defaultdict
from dataclasses import replace
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.config import Bm25Config
from rankloom.operators import lexical, postings_blocks
from rankloom.plans import testbed
from rankloom.sources import indexes

CORPUS = "doc_id long, title string, text string"


def ranked(run):
    return sorted((r.qid, r["rank"], r.doc_id, round(r.score, 9)) for r in run.collect())


@pytest.fixture(scope="module")
def tables(spark):
    source = random.Random(11)
    words = [f"w{int(source.paretovariate(0.7)) % 400}" for _ in range(4000)]
    docs = [
        (k, " ".join(source.sample(words, source.randint(0, 4))), " ".join(source.sample(words, source.randint(0, 60))))
        for k in range(3000)
    ]
    docs += [(10_000 + k, "", docs[5][2]) for k in range(30)]  # ties
    asked = [(k, " ".join(source.sample(words, source.randint(1, 25)))) for k in range(60)]
    asked += [(100, "w1 w1 w1 unknown"), (101, ""), (102, "unknown"), (103, docs[5][2])]
    return spark.createDataFrame(docs, CORPUS), spark.createDataFrame(asked, "qid long, text string")


@pytest.fixture(scope="module")
def index(spark, tables, tmp_path_factory):
    return indexes.write_text_index(spark, tables[0], str(tmp_path_factory.mktemp("blocks") / "index"), buckets=24)


@pytest.mark.parametrize("k", [1, 10, 200])
@pytest.mark.parametrize("boosts", [(("title", 2.0), ("text", 1.0)), (("text", 1.0),), (("title", 0.0), ("text", 1.0))])
def test_same_run_as_the_plain_plan(index, tables, k, boosts):
    plain = ranked(lexical.bm25_top_k(replace(index, blocks=()), tables[1], k, Bm25Config(boosts=boosts)))
    for prune in (True, False):
        assert ranked(lexical.bm25_top_k(index, tables[1], k, Bm25Config(boosts=boosts, prune=prune))) == plain


@pytest.mark.parametrize("settings", [{"k1": 0.0}, {"b": 0.0}, {"b": 1.0, "k1": 3.0}, {"broadcast_bytes": 20_000}])
def test_other_parameters_and_slices(index, tables, settings):
    config = Bm25Config(**settings)
    plain = ranked(lexical.bm25_top_k(replace(index, blocks=()), tables[1], 5, replace(config, broadcast_bytes=64 << 20)))
    assert ranked(lexical.bm25_top_k(index, tables[1], 5, config)) == plain


def test_cost_without_pruning_is_all_matches(spark, index, tables):
    cost = {r.qid: (r.postings, r.documents) for r in lexical.query_cost(index, tables[1], 10, Bm25Config(prune=False)).collect()}
    terms = lexical.query_terms(tables[1]).join(index.postings, "term")
    expected = {
        r.qid: (r.postings, r.documents)
        for r in terms.groupBy("qid").agg(F.count("*").alias("postings"), F.count_distinct("doc_id").alias("documents")).collect()
    }
    assert cost == expected
    pruned = {r.qid: (r.postings, r.documents) for r in lexical.query_cost(index, tables[1], 10).collect()}
    assert pruned.keys() == cost.keys() and all(a <= b for q in cost for a, b in zip(pruned[q], cost[q], strict=True))


def test_well_below_half_is_met_and_scored(spark, tmp_path):
    folder = "/root/testdata/sf0.1"
    if not Path(folder).exists():
        pytest.skip("test tables are not here")
    asked = testbed.queries(spark, folder)
    index = indexes.write_text_index(spark, testbed.corpus(spark, folder), str(tmp_path / "index"), buckets=24)
    sums = [
        lexical.query_cost(index, asked, 10, Bm25Config(prune=prune)).agg(F.sum("postings"), F.sum("documents")).first()
        for prune in (True, False)
    ]
    assert sums[0][0] < 0.45 * sums[1][0] and sums[0][1] < 0.2 * sums[1][1]


def test_blocks_hold_the_postings_and_their_bounds(spark, index):
    (found,) = index.blocks
    rows = found.blocks.collect()
    assert {r.shard for r in rows} <= set(found.shards) and len(set(found.shards)) == 24
    assert all(0 < len(r.docs) <= postings_blocks.BLOCK and r.docs == sorted(r.docs) for r in rows)
    assert all((r.max_tf, r.min_dl) == (max(r.tfs), min(r.dls)) for r in rows)
    held = sorted((d, r.field, r.term, tf, dl) for r in rows for d, tf, dl in zip(r.docs, r.tfs, r.dls, strict=True))
    assert held == sorted(map(tuple, index.postings.select("doc_id", "field", "term", "tf", "dl").collect()))
    owners = defaultdict(set)
    for r in rows:
        for d in r.docs:
            owners[d].add(r.shard)
    assert all(len(s) == 1 for s in owners.values())


def test_no_exchange_of_postings(spark, index, tables):
    run = lexical.bm25_top_k(index, tables[1], 10)
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(run._jdf.queryExecution(), "simple")
    assert plan.count("Exchange hashpartitioning") == 1 and "FlatMapGroupsInArrow" in plan
    above, below = plan.split("Exchange hashpartitioning")
    assert "FlatMapGroupsInArrow" in below and "WindowGroupLimit" in below and "FlatMapGroupsInArrow" not in above


def test_a_bound_that_meets_the_floor_is_kept():
    """Documents that come up to the floor exactly must not be lost."""
    weights = postings_blocks.Weights(
        pa.array([7]), np.zeros(3, int), np.zeros(3, int), np.arange(3), np.array([1.0, 2.0, 4.0]), np.zeros(3, int), np.ones(3)
    )
    rows = pa.table({"number": pa.array([0, 1, 2], pa.int32()), "docs": [[1, 2, 3, 4], [2, 3], [3, 9]], "tfs": [[1] * 4, [1] * 2, [1] * 2], "dls": [[1] * 4, [1] * 2, [1] * 2]})
    shard = postings_blocks.Shard(rows, weights, 0.0, 0.0)
    for floor, expected in ((4.0, {9: 4.0, 3: 7.0}), (3.0, {2: 3.0, 3: 7.0, 9: 4.0}), (7.0, {3: 7.0}), (7.5, {}), (-np.inf, {1: 1.0, 2: 3.0, 3: 7.0, 4: 1.0, 9: 4.0})):
        doc, score, _ = shard.best(weights.term, weights.weight, floor)
        assert dict(zip(shard.ids.take(pa.array(doc)).to_pylist(), score.tolist(), strict=True)) == expected


def test_text_ids_and_an_empty_index(spark, tmp_path, tables):
    corpus = spark.createDataFrame([("ü", "x", "y z"), ("b", "", "y y"), ("a", "x", "")], "doc_id string, title string, text string")
    asked = spark.createDataFrame([("q", "x y"), (None, "z")], "qid string, text string")
    index = indexes.write_text_index(spark, corpus, str(tmp_path / "one"), buckets=20)
    runs = [lexical.bm25_top_k(i, asked, 9).collect() for i in (index, replace(index, blocks=()))]
    assert len(runs[0]) == 4 and sorted(map(repr, runs[0])) == sorted(map(repr, runs[1]))
    empty = indexes.write_text_index(spark, corpus.limit(0), str(tmp_path / "two"), buckets=3)
    assert lexical.bm25_top_k(empty, asked, 3).collect() == []


def test_statistics_go_over_the_blocks_once(spark, tmp_path, monkeypatch):
    """Words of several fields are counted apart and together, and only the first goes over the blocks."""
    corpus = spark.createDataFrame([(n, "x y", f"x z z own{n}") for n in range(400)] + [(900, "x", None)], "doc_id long, title string, text string")
    real, seen = postings_blocks.whole_statistics, []
    monkeypatch.setattr(postings_blocks, "whole_statistics", lambda *a: seen.append(real(*a)) or seen[-1])
    index = indexes.write_text_index(spark, corpus, str(tmp_path / "index"), buckets=3)
    planned = lexical.index_corpus(corpus)
    for name in ("term_stats", "content_stats"):
        assert sorted(map(tuple, getattr(index, name).collect())) == sorted(map(tuple, getattr(planned, name).collect()))
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(seen[0]._jdf.queryExecution(), "simple")
    assert len(seen) == 1 and "postings_blocks" not in plan


def test_postings_are_read_off_the_blocks(spark, tmp_path, monkeypatch):
    """Words are counted into blocks; no row of a posting goes to a Python worker or comes from one."""
    packed, written = [], []
    real, unpack = postings_blocks.pack, postings_blocks.unpack
    monkeypatch.setattr(postings_blocks, "pack", lambda rows: packed.append(rows.columns) or real(rows))
    monkeypatch.setattr(postings_blocks, "unpack", lambda blocks: written.append(unpack(blocks)) or written[-1])
    corpus = spark.createDataFrame([(n, "x y", f"x z z own{n}") for n in range(400)] + [(900, "x", None), (901, None, "")], "doc_id long, title string, text string")
    index = indexes.write_text_index(spark, corpus, str(tmp_path / "index"), buckets=3)
    with indexes._whole_buckets(spark):
        plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(written[0]._jdf.queryExecution(), "simple")
    assert "Bucketed: true" in plan
    assert packed == [["shard", "doc_id", "title", "text"]] and "InArrow" not in plan and "Exchange" not in plan
    assert sorted(map(tuple, index.postings.collect())) == sorted(map(tuple, lexical.index_corpus(corpus).postings.collect()))
    # 400 documents in 3 shards: a term of all of them fills blocks, and leaves one not full per shard.
    assert index.blocks[0].blocks.where("term = 'z'").count() <= 400 // postings_blocks.BLOCK + 3
