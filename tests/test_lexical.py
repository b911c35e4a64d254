import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankloom.config import Bm25Config
from rankloom.functions.text import compose, words
from rankloom.operators import lexical
from rankloom.operators.ranking import top_k

DOCS = [
    ("a", "apple pie", "An apple a day. Apple, APPLE!"),
    ("b", "", "pie crust and pie filling with plum"),
    ("c", "plum", ""),
    ("d", "über straße", "größe über alles 42"),
    ("e", "nothing here", "unrelated words only"),
    ("f", "apple", "apple pie plum " * 30),
]
QUERIES = [("q1", "apple pie"), ("q2", "plum plum pie"), ("q3", "Straße ÜBER"), ("q4", "zebra"), ("q5", "")]


def brute_force(docs, queries, boosts, k1=1.2, b=0.75):
    tokens = {
        (doc, field): re.findall(r"[^\W_]+", text.lower())
        for doc, title, body in docs
        for field, text in (("title", title), ("text", body))
    }
    scores = {}
    for field, boost in boosts.items():
        present = {doc: Counter(t) for (doc, f), t in tokens.items() if f == field and t}
        n = len(present)
        avgdl = sum(sum(c.values()) for c in present.values()) / n
        df = Counter(term for counts in present.values() for term in counts)
        for qid, text in queries:
            for doc, counts in present.items():
                dl, total = sum(counts.values()), 0.0
                for term, qtf in Counter(re.findall(r"[^\W_]+", text.lower())).items():
                    if counts[term]:
                        idf = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
                        total += boost * qtf * idf * counts[term] / (counts[term] + k1 * (1 - b + b * dl / avgdl))
                if total:
                    scores[qid, doc] = max(total, scores.get((qid, doc), 0.0))
    return scores


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id string, title string, text string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "qid string, text string")


def scored(frame):
    return {(r.qid, r.doc_id): r.score for r in frame.collect()}


def test_words(spark):
    row = spark.range(1).select(words(F.lit("Don't stop_it: Größe-42, 3.14 déjà")).alias("w")).first()
    assert row.w == ["don't", "stop_it", "größe", "42", "3.14", "déjà"]
    cases = {
        "e.g. 'a' __ _a_": ["e.g", "a", "_a_"],
        "a.1 1.a a..b 1,000.5": ["a", "1", "1", "a", "a", "b", "1,000.5"],
        "e\u0301t x\u2019y \u0301": ["e\u0301t", "x\u2019y"],
    }
    for text, expected in cases.items():
        assert spark.range(1).select(words(F.lit(text)).alias("w")).first().w == expected
    assert spark.range(1).select(words(F.lit(None).cast("string")).alias("w")).first().w == []


@pytest.mark.parametrize(
    "text, expected",
    [
        ("東京都 Tokyo", ["東", "京", "都", "tokyo"]),
        ("ひらがなとカタカナ", ["ひ", "ら", "が", "な", "と", "カタカナ"]),
        ("コーヒー2杯", ["コーヒー", "2", "杯"]),
        ("ﾊﾝｶｸ ァ", ["ﾊﾝｶｸ", "ァ"]),
        ("한국어 단어", ["한국어", "단어"]),
        ("ไทย Привет мир", ["ไทย", "привет", "мир"]),
        ("abc漢don't字3.14", ["abc", "漢", "don't", "字", "3.14"]),
        ("か\u3099", ["か\u3099"]),
        ("\U00020000\U0002A6D6x", ["\U00020000", "\U0002A6D6", "x"]),
        ("hi 👩‍👩‍👧 ☀️ 👍🏽 🇩🇪🇫🇷 ok", ["hi", "👩‍👩‍👧", "☀️", "👍🏽", "🇩🇪", "🇫🇷", "ok"]),
        ("مرحبا بالعالم", ["مرحبا", "بالعالم"]),
        ("x" * 600 + " y", ["x" * 255, "x" * 255, "x" * 90, "y"]),
        ("é" * 256, ["é" * 255, "é"]),
        ("z" * 255, ["z" * 255]),
        ("漢 it's a_b 1,000.5 e\u0301t", ["漢", "it's", "a_b", "1,000.5", "e\u0301t"]),
    ],
)
def test_words_by_script(spark, text, expected):
    frame = spark.createDataFrame([(text,), ("plain Text",)], "t string")
    assert [r.w for r in frame.select(words(F.col("t")).alias("w")).collect()] == [expected, ["plain", "text"]]


def test_the_longer_pattern_gives_the_same_plain_words(spark, data_dir):
    """Texts without such scripts have the same words by either pattern."""
    from rankloom.functions import text as rules

    texts = spark.read.parquet(f"{data_dir}/documents.parquet").select(F.lower("text").alias("t"))
    either = [F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (rules.WORD_PATTERN, rules._SCRIPT_PATTERN)]
    assert texts.where(~either[0].eqNullSafe(either[1])).count() == 0


@pytest.mark.parametrize(
    "title, text",
    [("T", " body  \n"), ("", "  kept as is \n"), ("\xa0T", ""), (None, " x "), (" ", "y "), ("T", None)],
)
def test_compose(spark, title, text):
    frame = spark.createDataFrame([(title, text)], "title string, text string")
    got = frame.select(compose(F.col("title"), F.col("text")).alias("c")).first().c
    assert got == (f"{title}\n{text or ''}".strip() if title else text or "")


@pytest.mark.parametrize("boosts", [{"title": 2.0, "text": 1.0}, {"title": 1.0, "text": 1.0}, {"text": 1.0}])
def test_scores_agree_with_brute_force(corpus, queries, boosts):
    got = scored(lexical.score(lexical.index_corpus(corpus), queries, Bm25Config(boosts=tuple(boosts.items()))))
    expected = brute_force(DOCS, QUERIES, boosts)
    assert got.keys() == expected.keys()
    for pair, value in expected.items():
        assert got[pair] == pytest.approx(value, rel=1e-12), pair


def test_repeated_query_word_counts_twice(spark, corpus):
    index = lexical.index_corpus(corpus)
    config = Bm25Config(boosts=(("text", 1.0),))
    once = scored(lexical.score(index, spark.createDataFrame([("q", "plum")], "qid string, text string"), config))
    twice = scored(lexical.score(index, spark.createDataFrame([("q", "plum plum")], "qid string, text string"), config))
    assert once and all(twice[pair] == pytest.approx(2 * value) for pair, value in once.items())


def test_only_matching_documents_come_back(corpus, queries):
    run = lexical.bm25_top_k(lexical.index_corpus(corpus), queries, 100)
    counts = {r.qid: r.n for r in run.groupBy("qid").agg(F.count("*").alias("n")).collect()}
    assert counts == {"q1": 3, "q2": 4, "q3": 1}


def test_slices_of_the_queries_give_the_same_run(corpus, queries):
    """A small limit sends the queries to the postings one after the other."""
    index = lexical.index_corpus(corpus)
    sliced = sorted(map(tuple, lexical.bm25_top_k(index, queries, 3, Bm25Config(broadcast_bytes=300)).collect()))
    assert sliced == sorted(map(tuple, lexical.bm25_top_k(index, queries, 3).collect()))


def test_unknown_field_is_refused(corpus, queries):
    with pytest.raises(ValueError, match="no field titel; its fields are title, text"):
        lexical.bm25_top_k(lexical.index_corpus(corpus), queries, 3, Bm25Config(boosts=(("titel", 1.0),)))


def test_common_term_over_many_documents(spark):
    """One term in every document and a third of all query words, in several slices."""
    docs = [(i, "", f"common word{i} other{i % 7}") for i in range(2000)]
    asked = [(i, f"common common word{i}") for i in range(0, 60)]
    corpus = spark.createDataFrame(docs, "doc_id long, title string, text string")
    queries = spark.createDataFrame(asked, "qid long, text string")
    index = lexical.index_corpus(corpus, partitions=5)
    assert lexical.score(index, queries).count() == 60 * 2000
    top = lexical.bm25_top_k(index, queries, 1, Bm25Config(broadcast_bytes=20_000)).collect()
    assert {r.qid: r.doc_id for r in top} == {i: i for i, _ in asked}


def test_result_does_not_depend_on_partitions(corpus, queries):
    def run(n):
        index = lexical.index_corpus(corpus.repartition(n), partitions=n)
        return sorted(map(tuple, lexical.bm25_top_k(index, queries.repartition(n), 3).collect()))

    assert [r[:2] + r[3:] for r in run(1)] == [r[:2] + r[3:] for r in run(8)]


def test_ties_by_document_id(spark):
    corpus = spark.createDataFrame([(i, "", "same text") for i in range(50)], "doc_id long, title string, text string")
    queries = spark.createDataFrame([("q", "same")], "qid string, text string")
    run = lexical.bm25_top_k(lexical.index_corpus(corpus), queries, 5)
    assert [r.doc_id for r in run.orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_deep_cut_equals_plain_ranking(spark):
    rows = spark.range(3000).select(
        F.lit("q").alias("qid"), F.col("id").alias("doc_id"), (F.col("id") % 17).cast("double").alias("score")
    )
    got = [(r.doc_id, r["rank"]) for r in top_k(rows, 1500).orderBy("rank").collect()]
    expected = sorted(range(3000), key=lambda i: (-(i % 17), i))[:1500]
    assert got == [(doc, place + 1) for place, doc in enumerate(expected)]


def test_empty_corpus(spark, queries):
    corpus = spark.createDataFrame([], "doc_id string, title string, text string")
    assert lexical.bm25_top_k(lexical.index_corpus(corpus), queries, 10).count() == 0


@pytest.mark.parametrize("k", [0, -3])
def test_k_must_be_positive(corpus, queries, k):
    with pytest.raises(ValueError):
        lexical.bm25_top_k(lexical.index_corpus(corpus), queries, k)


def test_a_planned_index_counts_a_bounded_part_of_the_text_per_task(spark, monkeypatch):
    corpus = spark.createDataFrame([(n, f"t{n}", f"w{n} " * 50) for n in range(200)], "doc_id long, title string, text string")
    expected = sorted(tuple(r) for r in lexical.index_corpus(corpus).term_stats.collect())
    monkeypatch.setattr(lexical, "_PLANNED_BYTES", 1000)
    index = lexical.index_corpus(corpus)
    assert index.postings.rdd.getNumPartitions() >= 30
    assert sorted(tuple(r) for r in index.term_stats.collect()) == expected
