import json
from contextlib import contextmanager
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rankloom.config import DatasetConfig, EvalConfig
from rankloom.operators import lexical
from rankloom.sources import datasets, indexes, reports


@pytest.fixture()
def dataset(tmp_path):
    folder = tmp_path / "tiny"
    (folder / "qrels").mkdir(parents=True)
    docs = [
        {"_id": "d1", "title": "One", "text": "first text"},
        {"_id": "d2", "title": "", "text": "second"},
        {"_id": "d3", "text": "no title"},
        {"_id": "d4", "title": "Only title"},
    ]
    (folder / "corpus.jsonl").write_text("".join(json.dumps(d, ensure_ascii=False) + "\n" for d in docs), "utf-8")
    (folder / "queries.jsonl").write_text('{"_id": "q1", "text": "é one"}\n{"_id": "q2", "text": "two"}\n', "utf-8")
    (folder / "qrels" / "test.tsv").write_text(
        "query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td2\t0\nq2\td9\t2\nq2\td9\t2\n", "utf-8"
    )
    (folder / "qrels" / "dev.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td2\t1\n", "utf-8")
    return DatasetConfig(base_dir=str(tmp_path), name="tiny")


def pairs(frame):
    return {tuple(r) for r in frame.select("qid", "doc_id").collect()}


def test_dataset(spark, dataset):
    corpus, queries, qrels = datasets.load_dataset(spark, dataset)
    assert {tuple(r) for r in corpus.collect()} == {
        ("d1", "One", "first text"),
        ("d2", "", "second"),
        ("d3", "", "no title"),
        ("d4", "Only title", ""),
    }
    assert {r.qid: r.text for r in queries.collect()} == {"q1": "é one", "q2": "two"}
    assert pairs(qrels) == {("q1", "d1"), ("q2", "d9")}
    assert qrels.count() == 2


def test_threshold_and_split(spark, dataset):
    path = datasets.qrels_path(dataset)
    assert pairs(datasets.read_qrels(spark, path, 2)) == {("q2", "d9")}
    assert pairs(datasets.read_qrels(spark, path, 0)) == {("q1", "d1"), ("q1", "d2"), ("q2", "d9")}
    dev = DatasetConfig(base_dir=dataset.base_dir, name="tiny", split="dev")
    assert pairs(datasets.load_dataset(spark, dev)[2]) == {("q1", "d2")}


def test_broken_line_raises(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "text": "ok"}\n{"_id": \n', "utf-8")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        datasets.read_corpus(spark, str(tmp_path / "corpus.jsonl")).collect()


def test_broken_lines_are_set_aside(spark, tmp_path):
    lines = [
        '{"_id": "d1", "title": "T", "text": "ok"}',
        '{"_id": "d2", "text": ',
        "not json at all",
        '{"title": "no id", "text": "x"}',
        '{"_id": "d3"}',
        '{"_id": "d4", "text": "fine", "more": 1}',
    ]
    path = str(tmp_path / "corpus.jsonl")
    Path(path).write_text("\n".join(lines) + "\n", "utf-8")
    found = datasets.check_corpus(spark, path)
    assert {tuple(r) for r in found.good.collect()} == {("d1", "T", "ok"), ("d3", "", ""), ("d4", "", "fine")}
    lost = {(r.reason, r.line) for r in found.rejected.collect()}
    assert lost == {("malformed", lines[1]), ("malformed", lines[2]), ("no id", '{"title":"no id","text":"x"}')}
    assert (found.n_good, found.n_rejected) == (3, 3)
    with pytest.raises(datasets.TooManyRejected, match="3 of 6 lines of .*malformed: not json at all"):
        datasets.check_corpus(spark, path, most=0.1)
    assert datasets.check_corpus(spark, path, most=0.5).n_good == 3


def test_broken_queries_and_judgments(spark, tmp_path):
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "a"}\n{"_id": "q2"\n{"text": "b"}\n', "utf-8")
    found = datasets.check_queries(spark, str(tmp_path / "queries.jsonl"))
    assert [tuple(r) for r in found.good.collect()] == [("q1", "a")] and (found.n_good, found.n_rejected) == (1, 2)
    (tmp_path / "test.tsv").write_text(
        "query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td2\t0\nq1\td3\tmuch\nq2\t\t1\nq3\td3\t2\nq3\td3\t2\n", "utf-8"
    )
    judged = datasets.check_qrels(spark, str(tmp_path / "test.tsv"))
    assert pairs(judged.good) == {("q1", "d1"), ("q3", "d3")} and (judged.n_good, judged.n_rejected) == (4, 2)
    assert {r.reason for r in judged.rejected.collect()} == {"malformed", "no id"}
    (tmp_path / "empty.jsonl").write_text("", "utf-8")
    nothing = datasets.check_corpus(spark, str(tmp_path / "empty.jsonl"), most=0.0)
    assert nothing.good.collect() == [] and nothing.rejected.collect() == [] and nothing.n_good == 0


CORPUS = "doc_id string, title string, text string"


def rows(index):
    return {
        name: sorted(map(str, getattr(index, name).collect()))
        for name in ("postings", "doc_len", "field_stats", "term_stats", "content_stats")
    }


def test_index_round_trip(spark, tmp_path):
    corpus = spark.createDataFrame([("a", "x y", "x z z"), ("b", "", "y"), ("c", "", "")], CORPUS)
    path = str(tmp_path / "index")
    written = indexes.write_text_index(spark, corpus, path, buckets=3)
    planned = lexical.index_corpus(corpus)
    assert rows(written) == rows(planned)
    assert rows(indexes.load_text_index(spark, path)) == rows(planned)


@pytest.mark.parametrize("rows_per_batch", ["1", "3", "10000"])
def test_postings_and_statistics_from_batches(spark, tmp_path, rows_per_batch):
    """Words are counted by batches and statistics added up from blocks, wherever a batch ends."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    texts = [("a", "x y", "x z z y"), ("b", None, "y \u00e9 \u4e2d\u6587"), ("c", "", ""), ("d", "x", "x"), ("e", "y x", None), ("f", "z", "z x z")]
    corpus = spark.createDataFrame(texts, CORPUS)
    planned = rows(lexical.index_corpus(corpus))
    spark.conf.set(name, rows_per_batch)
    try:
        counted = lexical.counted_postings(corpus.coalesce(1))
        assert sorted(map(str, counted.collect())) == planned["postings"]
        written = indexes.write_text_index(spark, corpus, str(tmp_path / "index"), buckets=2)
        assert rows(written) == planned
    finally:
        spark.conf.set(name, before)


def test_batches_of_postings_are_not_measured_row_by_row(spark, tmp_path, monkeypatch):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(name), []
    real = indexes.postings_blocks.pack
    monkeypatch.setattr(indexes.postings_blocks, "pack", lambda rows: seen.append(real(rows)) or seen[-1])
    during = []
    whole = indexes._whole_buckets

    @contextmanager
    def watched(session):
        with whole(session):
            during.append(session.conf.get(name))
            yield

    monkeypatch.setattr(indexes, "_whole_buckets", watched)
    indexes.write_text_index(spark, spark.createDataFrame([("a", "x", "y")], CORPUS), str(tmp_path / "index"))
    # The largest number is Spark's word for no limit, under which it need not add up sizes.
    assert during == [f"{2**31 - 1}b"] or during == [str(2**31 - 1)]
    assert len(seen) == 1 and spark.conf.get(name) == before


def test_index_is_replaced_or_extended(spark, tmp_path):
    before = spark.createDataFrame([("a", "x", "old text"), ("b", "y", "kept")], CORPUS)
    change = spark.createDataFrame([("a", "", "new words"), ("c", "z", "added")], CORPUS)
    index = indexes.write_text_index(spark, before, str(tmp_path / "one"))
    merged = indexes.upsert_text_index(spark, index, change, str(tmp_path / "two"))
    expected = change.unionByName(before.where("doc_id = 'b'"))
    assert rows(merged) == rows(lexical.index_corpus(expected))
    replaced = indexes.write_text_index(spark, change, str(tmp_path / "one"))
    assert rows(replaced) == rows(lexical.index_corpus(change))


def test_search_on_a_written_index_moves_no_pairs(spark, tmp_path):
    """One shuffle of the pairs: the k best of each partition, by query."""
    corpus = spark.createDataFrame([(f"d{i}", "t", f"common w{i}") for i in range(50)], CORPUS)
    index = indexes.write_text_index(spark, corpus, str(tmp_path / "index"), buckets=4)
    queries = spark.createDataFrame([("q", "common w7")], "qid string, text string")
    run = lexical.bm25_top_k(index, queries, 3)
    plan = run._sc._jvm.PythonSQLUtils.explainString(run._jdf.queryExecution(), "simple")
    pairs_side = plan.split("BroadcastExchange")[0]
    assert pairs_side.count("Exchange hashpartitioning") == 1
    assert pairs_side.index("WindowGroupLimit") < pairs_side.index("Exchange hashpartitioning")
    assert "Partial" in pairs_side.split("Exchange hashpartitioning")[1]
    assert run.where("rank = 1").first().doc_id == "d7"


def test_upsert_moves_only_the_new_documents(spark, tmp_path):
    corpus = spark.createDataFrame([(f"d{i}", "t", f"common w{i}") for i in range(60)], CORPUS)
    index = indexes.write_text_index(spark, corpus, str(tmp_path / "index"), buckets=5)
    merged = indexes.merged_postings(index, corpus.limit(3), index.buckets)
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(merged._jdf.queryExecution(), "simple")
    scan = next(k for k, line in enumerate(plan.splitlines()) if "FileScan" in line)
    above = plan.splitlines()[:scan]
    join = max(k for k, line in enumerate(above) if "SortMergeJoin" in line)
    assert not any("Exchange" in line for line in above[join:])


def test_a_query_of_one_word_reads_few_postings(spark, tmp_path):
    """The reader skips pages by the order of terms: pages of 20,000 rows in one bucket of many."""
    corpus = spark.range(40_000).selectExpr(
        "concat('d', id) AS doc_id", "'' AS title", "concat_ws(' ', concat('w', id % 5000), concat('v', id % 4000), concat('x', id % 3000), concat('y', id % 2000)) AS text"
    )
    index = indexes.write_text_index(spark, corpus, str(tmp_path / "index"), buckets=1)
    queries = spark.createDataFrame([("q", "w77")], "qid string, text string")
    run = lexical.bm25_top_k(index, queries, 3)
    assert run.count() == 3
    scans = [line for line in run._sc._jvm.PythonSQLUtils.explainString(run._jdf.queryExecution(), "simple").splitlines() if "postings" in line]
    assert any("w77" in line.split("PushedFilters")[1] for line in scans)
    read = index.postings.where("term = 'w77'")
    assert len(read.collect()) == 8
    (scan,) = [read._jdf.queryExecution().executedPlan().collectLeaves().apply(0)]
    assert scan.metrics().get("numOutputRows").get().value() <= 40_000 and index.postings.count() == 160_000


def test_opening_leaves_the_declared_tables_alone(spark, tmp_path):
    corpus = spark.createDataFrame([("a", "x", "it's")], CORPUS)
    path = str(tmp_path / "it's an index")
    index = indexes.write_text_index(spark, corpus, path)
    before = {t.name for t in spark.catalog.listTables() if t.name.startswith("rankloom_")}
    again = indexes.load_text_index(spark, path)
    assert rows(again) == rows(index) and again.buckets == index.buckets
    assert {t.name for t in spark.catalog.listTables() if t.name.startswith("rankloom_")} == before


def test_faulty_documents_are_shown(spark, tmp_path):
    twice = spark.createDataFrame([("a", "", "x"), ("a", "", "y"), ("b", "", "z")], CORPUS)
    with pytest.raises(RuntimeError, match=r"a \(2 rows\)"):
        indexes.write_text_index(spark, twice, str(tmp_path / "index"))
    with pytest.raises(RuntimeError, match="None"):
        indexes.check_documents(spark.createDataFrame([(None, "", "x")], CORPUS))
    many = spark.createDataFrame([(f"d{i % 9}", "", "x") for i in range(18)], CORPUS)
    with pytest.raises(RuntimeError) as error:
        indexes.check_documents(many)
    assert str(error.value).count("rows)") == 3


def test_latest_document_wins(spark):
    versions = spark.createDataFrame(
        [("a", "", "old", 1), ("a", "t", "new", 2), ("b", "", "only", 1)], CORPUS + ", seq int"
    )
    assert {tuple(r) for r in indexes.latest_documents(versions, "seq").collect()} == {
        ("a", "t", "new"),
        ("b", "", "only"),
    }


def test_missing_index(spark, tmp_path):
    with pytest.raises(indexes.IndexNotFound, match="no text index at"):
        indexes.load_text_index(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError, match="vector index"):
        indexes.load_vectors(spark, str(tmp_path / "none"))


def test_vectors(spark, tmp_path):
    path = str(tmp_path / "vectors")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "doc_id string, embedding array<float>")
    indexes.write_vectors(vectors, path)
    assert {r.doc_id: r.embedding for r in indexes.load_vectors(spark, path).collect()} == {
        "a": [1.0, 0.0],
        "b": [0.0, 1.0],
    }
    other = str(tmp_path / "other")
    vectors.select("doc_id", F.lit("x").alias("embedding")).write.parquet(other)
    with pytest.raises(ValueError, match="invalid vector index"):
        indexes.load_vectors(spark, other)


TABLE = "method string, `recall@1` double, `recall@10` double, `precision@10` double, `mrr@10` double, `ndcg@10` double, avg_latency_ms double"


@pytest.fixture()
def table(spark):
    return spark.createDataFrame(
        [
            ("hybrid", 0.5, 0.8, 0.1, 0.6, 0.7, 30.0),
            ("bm25", 0.5, 0.7, 0.1, 0.5, 0.6, 10.0),
            ("dense", 0.4, 0.8, 0.1, 0.4, 0.5, 20.0),
        ],
        TABLE,
    )


def only_file(folder):
    (part,) = [p for p in Path(folder).iterdir() if p.name.startswith("part-")]
    return part.read_text("utf-8")


def test_csv(table, tmp_path):
    reports.write_csv(table, str(tmp_path / "csv"))
    lines = only_file(tmp_path / "csv").splitlines()
    assert lines[0] == ",".join(table.columns)
    assert [line.split(",")[0] for line in lines[1:]] == ["bm25", "dense", "hybrid"]


def test_json(spark, table, tmp_path):
    path = tmp_path / "json"
    reports.write_json(table, EvalConfig(dataset="tëst"), str(path))
    text = only_file(path)
    document = json.loads(text)
    assert document["config"]["dataset"] == "tëst" and document["config"]["ks"] == [1, 3, 5, 10]
    assert "\n" in text.strip() and list(document["rows"][0]) == sorted(document["rows"][0])
    back = reports.read_report(spark, str(path))
    assert {r.method: r["recall@10"] for r in back.collect()} == {"bm25": 0.7, "dense": 0.8, "hybrid": 0.8}


def test_report_without_a_column(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"rows": [{"method": "bm25", "recall@10": 0.5}]}')
    with pytest.raises(KeyError, match="no avg_latency_ms, only.*recall@10"):
        reports.read_report(spark, str(tmp_path / "r.json"))


def test_markdown(table, tmp_path):
    reports.write_markdown(table, str(tmp_path / "md"))
    text = only_file(tmp_path / "md")
    assert "| bm25 | 0.5000 | 0.7000 | 0.5000 | 10.0000 |" in text
    assert "precision" not in text and "ndcg" not in text
    assert "| mrr@10 | hybrid | 0.1000 |" in text and "| recall@10 | dense | 0.0000 |" in text
    assert all(f"| {method} | 1 |" in text for method in ("bm25", "dense", "hybrid"))
    assert "Least time per query: bm25, 10.0000 ms." in text


def test_markdown_of_one_method(table):
    text = "\n".join(reports.summary_lines(table.where("method = 'bm25'")))
    assert "| bm25 | 0.5000" in text and "leader" not in text and "Least" not in text
