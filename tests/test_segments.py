"""The segmented index against a full rebuild."""

import random
from pathlib import Path

import pytest

from rankloom.operators import lexical
from rankloom.sources import indexes, segments
from rankloom.sources.indexes import IndexNotFound
from rankloom.sources.segments import Segment

CORPUS = "doc_id string, title string, text string"
TABLES = ("postings", "doc_len", "field_stats", "term_stats", "content_stats")


def made(seed, ids):
    source = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    return {
        f"d{k}": (" ".join(source.choices(words, k=source.randint(0, 3))), " ".join(source.choices(words, k=source.randint(0, 30))))
        for k in ids
    }


def frame(spark, docs):
    return spark.createDataFrame([(k, *v) for k, v in docs.items()], CORPUS)


def rows(index):
    return {
        name: sorted(tuple(r[c] for c in sorted(r.asDict())) for r in getattr(index, name).collect()) for name in TABLES
    }


def ranked(run):
    return sorted((r.qid, r["rank"], r.doc_id, round(r.score, 9)) for r in run.collect())


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([("a", "w1 w2 w3 w4"), ("b", "w5 w5 w59"), ("c", "w10 none")], "qid string, text string")


def same_as_rebuilt(spark, index, docs, asked):
    rebuilt = lexical.index_corpus(frame(spark, docs))
    assert rows(index) == rows(rebuilt)
    assert ranked(lexical.bm25_top_k(index, asked, 7)) == ranked(lexical.bm25_top_k(rebuilt, asked, 7))


def test_upserts_deletions_and_merges(spark, tmp_path, asked):
    path = str(tmp_path / "index")
    docs = made(1, range(80))
    docs["d7"] = ("", "")  # without a word
    segments.create(spark, frame(spark, docs), path, buckets=3)
    for step, ids in enumerate((range(70, 95), [75, 76], [7, 200])):
        change = made(10 + step, ids)
        if step == 2:
            change["d200"] = ("", "...")  # a document that loses all its words
        index = segments.upsert(spark, frame(spark, change), path)
        docs |= change
    same_as_rebuilt(spark, index, docs, asked)
    gone = ["d1", "d2", "d75", "d94", "unknown"]
    index = segments.delete(spark, spark.createDataFrame([(k,) for k in gone], "doc_id string"), path)
    for k in gone:
        docs.pop(k, None)
    same_as_rebuilt(spark, index, docs, asked)

    before = segments.read_manifest(spark, path)
    assert len(before.segments) == 4 and before.deletions
    index = segments.merge(spark, path, tier=2, most_deleted=0.3)
    after = segments.read_manifest(spark, path)
    assert after.version == before.version + 1 and len(after.segments) < 4
    assert sum(s.live for s in after.segments) == sum(s.live for s in before.segments)
    same_as_rebuilt(spark, index, docs, asked)
    index = segments.upsert(spark, frame(spark, made(99, [3, 500])), path)
    docs |= made(99, [3, 500])
    same_as_rebuilt(spark, index, docs, asked)

    # Earlier versions can still be opened.
    first = segments.open_index(spark, path, 1)
    assert rows(first) == rows(lexical.index_corpus(frame(spark, made(1, range(80)) | {"d7": ("", "")})))


def size(path):
    return {str(p): p.stat().st_size for p in Path(path).rglob("*.parquet")}


def test_an_upsert_writes_in_proportion_to_it(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = {f"d{k}": ("a title", " ".join(f"w{(k * 31 + j * 17) % 5000}" for j in range(120))) for k in range(6000)}
    segments.create(spark, frame(spark, docs), path, buckets=4)
    before = size(path)
    segments.upsert(spark, frame(spark, {"d5": ("new", "other words")}), path)
    one = size(path)
    assert all(one[name] == n for name, n in before.items()), "what is written is never changed"
    added = sum(n for name, n in one.items() if name not in before)
    assert added < 0.02 * sum(before.values())
    segments.upsert(spark, frame(spark, {f"d{k}": ("new", " ".join(f"w{(k + j) % 900}" for j in range(120))) for k in range(300)}), path)
    more = sum(n for name, n in size(path).items() if name not in one)
    assert added < more < 0.3 * sum(before.values())


def test_merge_rule():
    def named(*sizes):
        return [Segment(f"s{k}", *(n if isinstance(n, tuple) else (n,))) for k, n in enumerate(sizes)]

    def names(groups):
        return [[s.name for s in group] for group in groups]

    assert segments.due(named(100, 100, 100)) == []
    assert names(segments.due(named(1000, 70, 80, 100, 200, 5000))) == [["s1", "s2", "s3", "s4"]]
    assert names(segments.due(named(1000, 5, 6, 7, 4, 3, 3))) == [["s1", "s2", "s3", "s4"]]
    assert names(segments.due(named((1000, 600), (1000, 400)))) == [["s0"]]
    # With every merge a document moves up a tier, so it is written again only as often as there are tiers.
    live, written, last = [], 0, 0
    for _ in range(256):
        live.append(Segment(f"x{last}", 1))
        last += 1
        while groups := segments.due(live):
            for group in groups:
                total = sum(s.live for s in group)
                written += total
                live = [s for s in live if s not in group] + [Segment(f"x{last}", total)]
                last += 1
    assert len(live) <= 4 * 4 and written <= 256 * 5


def test_refusals(spark, tmp_path):
    with pytest.raises(IndexNotFound, match="no manifest"):
        segments.open_index(spark, str(tmp_path / "none"))
    path = str(tmp_path / "index")
    segments.create(spark, frame(spark, made(1, range(5))), path)
    with pytest.raises(IndexNotFound, match="no version 9"):
        segments.open_index(spark, path, 9)
    twice = frame(spark, made(1, [1])).unionByName(frame(spark, made(2, [1])))
    with pytest.raises(RuntimeError, match="repeated id"):
        segments.upsert(spark, twice, path)
    assert segments.read_manifest(spark, path).version == 1


def test_all_documents_deleted(spark, tmp_path, asked):
    path = str(tmp_path / "index")
    segments.create(spark, frame(spark, made(1, range(5))), path)
    index = segments.upsert(spark, frame(spark, made(2, [9])), path)
    ids = spark.createDataFrame([(f"d{k}",) for k in range(5)], "doc_id string")
    index = segments.delete(spark, ids, path)
    same_as_rebuilt(spark, index, made(2, [9]), asked)
    index = segments.merge(spark, path)
    same_as_rebuilt(spark, index, made(2, [9]), asked)
    assert len(segments.read_manifest(spark, path).segments) == 1


def test_blocks_of_deleted_documents_are_not_found(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = {f"d{k}": ("", f"common w{k}") for k in range(200)}
    segments.create(spark, frame(spark, docs), path, buckets=20)
    index = segments.delete(spark, spark.range(150).selectExpr("concat('d', id) AS doc_id"), path)
    assert index.blocks[0].gone is not None
    run = lexical.bm25_top_k(index, spark.createDataFrame([("q", "common")], "qid string, text string"), 100)
    assert {r.doc_id for r in run.collect()} == {f"d{k}" for k in range(150, 200)}
    assert indexes.load_text_index(spark, f"{path}/segments/{segments.read_manifest(spark, path).segments[0].name}").n_docs == 200


def test_texts_are_checked_and_measured_once(spark, tmp_path, monkeypatch):
    """A segment is checked once, and its ids are set aside before segments are asked for them one by one."""
    checks, kept = [], []
    real, keep = segments.check_documents, segments.materialise
    for module in (segments, segments.indexes):
        monkeypatch.setattr(module, "check_documents", lambda corpus: checks.append(1) or real(corpus))
    monkeypatch.setattr(segments, "materialise", lambda df, label, *a: kept.append(label) or keep(df, label, *a))
    path = str(tmp_path / "index")
    segments.create(spark, frame(spark, made(1, range(20))), path)
    index = segments.upsert(spark, frame(spark, made(2, range(10, 30))), path)
    assert len(checks) == 2 and kept.count("changed-documents") == 1
    assert index.doc_len.select("doc_id").distinct().count() == len({r.doc_id for r in index.postings.collect()})
