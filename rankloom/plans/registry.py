"""Named queries over the test tables. Each takes a session and a data folder."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.config import Bm25Config, DatasetConfig, EvalConfig, HybridConfig
from rankloom.functions.text import compose
from rankloom.operators import cells, certified, encoding, fusion, lexical, metrics, report, rerank, sampling
from rankloom.operators.dense import cosine_top_k, dense_top_k, dimension_counts, mismatches, normalized
from rankloom.operators.encoding import hash_documents
from rankloom.operators.retrievers import HybridRetriever
from rankloom.plans import testbed
from rankloom.plans.evaluation import evaluate
from rankloom.session import scratch_path
from rankloom.sources import datasets, indexes, reports, segments

Query = Callable[[SparkSession, str], DataFrame]

K = testbed.K
KS = (1, 3, 5, 10)
DEEP_K = 150
DIGITS = 6
SAMPLE = 25
# Characters of a text that goes into the index first.
SHORT = 1000
CELLS = 32
BROKEN_STEP = 17
# Characters of a padded batch of texts.
BUDGET = 1 << 17
SEED = 42


def _ranked(run: DataFrame, *extra: str) -> DataFrame:
    """A run as it is compared: score to six decimals, rank as an int."""
    return run.select(
        *extra, "qid", "doc_id", F.round("score", DIGITS).alias("score"), F.col("rank").cast("int").alias("rank")
    )


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(f"`{c}`", DIGITS).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])


# Sources and sinks


def corpus_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "corpus-jsonl")
    rows = testbed.corpus(spark, sf_dir).withColumnRenamed("doc_id", "_id")
    rows.withColumn("_id", F.col("_id").cast("string")).write.json(path)
    return datasets.read_corpus(spark, path)


def corpus_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of all documents in which every 17th line lacks its end: which lines are read, which set aside."""
    path = scratch_path(spark, "corpus-broken")
    rows = testbed.corpus(spark, sf_dir)
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("_id"), "title", "text"))
    whole = F.col("doc_id") % BROKEN_STEP != 0
    cut = F.substr(line, F.lit(1), F.length(line) - 1)
    rows.select(F.when(whole, line).otherwise(cut).alias("value")).write.text(path)
    found = datasets.check_corpus(spark, path)
    lost = found.rejected.select(F.regexp_extract("line", r'^\{"_id":"([^"]*)"', 1).alias("doc_id"), "reason")
    return found.good.select("doc_id", F.lit("read").alias("reason")).unionByName(lost).select(
        "doc_id", "reason", F.lit(found.n_good).alias("n_good"), F.lit(found.n_rejected).alias("n_rejected")
    )


def queries_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "queries-jsonl")
    testbed.queries(spark, sf_dir).select(F.col("qid").cast("string").alias("_id"), "text").write.json(path)
    return datasets.read_queries(spark, path)


def qrels_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "qrels-tsv")
    testbed.table(spark, sf_dir, "labels").select(
        F.lit("quality").alias("query-id"),
        F.col("doc_id").cast("string").alias("corpus-id"),
        F.col("quality").alias("score"),
    ).write.csv(path, sep="\t", header=True)
    return datasets.read_qrels(spark, path)


def qrels_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = testbed.table(spark, sf_dir, "labels").select(
        F.lit("quality").alias("qid"), "doc_id", F.col("quality").alias("score")
    )
    return datasets.binary_qrels(scored, 1)


def qrels_from_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testbed.derive_qrels(spark, sf_dir)


def text_index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "index-roundtrip")
    indexes.write_text_index(spark, testbed.corpus(spark, sf_dir), path)
    return indexes.load_text_index(spark, path).postings


def text_index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index all documents by title only, then replace those that have a text by the full ones."""
    corpus = testbed.corpus(spark, sf_dir)
    first = scratch_path(spark, "index-before")
    before = indexes.write_text_index(spark, corpus.withColumn("text", F.lit("")), first)
    full = corpus.where(F.col("text") != "")
    after = indexes.upsert_text_index(spark, before, full, scratch_path(spark, "index-after"))
    return after.term_stats


def text_index_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by title only, then those with a text put in their place, the short ones first: three
    segments and two deletion sets. Postings with what the statistics say of their terms."""
    corpus = testbed.corpus(spark, sf_dir)
    path = scratch_path(spark, "index-segments")
    segments.create(spark, corpus.withColumn("text", F.lit("")), path)
    short = F.length("text") < SHORT
    segments.upsert(spark, corpus.where((F.col("text") != "") & short), path)
    index = segments.upsert(spark, corpus.where(~short), path)
    idf = lexical.term_idf(index.term_stats, index.field_stats)
    return _rounded(index.postings.join(idf, ["field", "term"]), "idf")


def vector_index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "vectors-roundtrip")
    indexes.write_vectors(_embeddings(spark, sf_dir, "doc_id"), path)
    loaded = indexes.load_vectors(spark, path)
    return _positions(loaded, "doc_id")


# Projections and filters


def doc_text_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testbed.corpus(spark, sf_dir).select("doc_id", compose(F.col("title"), F.col("text")).alias("content"))


def eligible_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.eligible_queries(testbed.queries(spark, sf_dir), testbed.qrels(spark, sf_dir))


def sample_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_queries(testbed.queries(spark, sf_dir), SAMPLE, SEED)


def sample_by_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_by_ordinal(testbed.queries(spark, sf_dir), SAMPLE, SEED)


# Lexical retrieval


def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.tokenize(testbed.corpus(spark, sf_dir))


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_frequency(testbed.corpus(spark, sf_dir))


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.doc_lengths(testbed.corpus(spark, sf_dir))


def field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = lexical.doc_lengths(testbed.corpus(spark, sf_dir))
    return _rounded(lexical.field_statistics(lengths), "avgdl")


def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.index_corpus(testbed.corpus(spark, sf_dir))
    return _rounded(lexical.term_idf(index.term_stats, index.field_stats), "idf")


def content_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(encoding.content_idf(lexical.index_corpus(testbed.corpus(spark, sf_dir))), "idf")


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.query_terms(testbed.queries(spark, sf_dir))


def _bm25(spark: SparkSession, sf_dir: str, k: int = K, config: Bm25Config = Bm25Config()) -> DataFrame:
    return lexical.bm25_top_k(testbed.text_index(spark, sf_dir), testbed.queries(spark, sf_dir), k, config)


def bm25_single_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(_bm25(spark, sf_dir, config=Bm25Config(boosts=(("text", 1.0),))))


def bm25_multi_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(_bm25(spark, sf_dir, testbed.RUN_DEPTH))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(_bm25(spark, sf_dir))


def bm25_field_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for boost in (1.0, 2.0):
        config = Bm25Config(boosts=(("title", boost), ("text", 1.0)))
        run = _bm25(spark, sf_dir, config=config).withColumn("title_boost", F.lit(boost))
        parts.append(_ranked(run, "title_boost"))
    return parts[0].unionByName(parts[1])


def bm25_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run over an index that came about in several steps and was merged."""
    corpus = testbed.corpus(spark, sf_dir)
    path = scratch_path(spark, "index-merged")
    segments.create(spark, corpus.withColumn("text", F.lit("")), path)
    segments.upsert(spark, corpus.where(F.length("text") >= SHORT), path)
    segments.upsert(spark, corpus.where(F.length("text") < SHORT), path)
    index = segments.merge(spark, path, tier=2)
    return _ranked(lexical.bm25_top_k(index, testbed.queries(spark, sf_dir), K))


def query_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings and documents that a search without pruning meets for every query."""
    index, asked = testbed.text_index(spark, sf_dir), testbed.queries(spark, sf_dir)
    return lexical.query_cost(index, asked, K, Bm25Config(prune=False))


# Dense retrieval


def _embeddings(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return testbed.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(key), "embedding")


def _positions(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.select(key, F.posexplode("embedding").alias("pos", "x")).select(
        key, "pos", F.round(F.col("x").cast("double"), DIGITS).alias("value")
    )


def hash_embed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = testbed.corpus(spark, sf_dir)
    index = testbed.text_index(spark, sf_dir)
    vectors = hash_documents(index, corpus, testbed.DENSE)
    return _positions(vectors, "doc_id")


def letter_shares(texts: Sequence[str]) -> np.ndarray:
    """A stand-in for a model: how often each of the letters a-z and the digits occurs."""
    return np.array([[text.count(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789"] for text in texts], dtype=np.float64)


def encoder_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the hook for any batch encoder."""
    return _positions(encoding.encode(encoding.document_text(testbed.corpus(spark, sf_dir)), letter_shares), "doc_id")


def encoder_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``encoder_hook``, in batches of like length."""
    texts = encoding.document_text(testbed.corpus(spark, sf_dir))
    return _positions(encoding.encode_by_length(texts, letter_shares, BUDGET), "doc_id")


def word_overlap(asked: Sequence[str], texts: Sequence[str]) -> np.ndarray:
    """A stand-in for a pair model: the part of a query's distinct words that the text has."""
    words = [[set(re.findall("[a-z0-9]+", text.lower())) for text in side] for side in (asked, texts)]
    return np.array([len(q & t) / len(q) if q else 0.0 for q, t in zip(*words, strict=True)])


def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The BM25 run ranked anew by a scorer that reads the texts."""
    path = scratch_path(spark, "texts")
    texts = rerank.write_texts(spark, encoding.document_text(testbed.corpus(spark, sf_dir)), path)
    run = testbed.runs(spark, sf_dir)["bm25"]
    return _ranked(rerank.rerank_top_k(run, testbed.queries(spark, sf_dir), texts, word_overlap, K))


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(normalized(_embeddings(spark, sf_dir, "vec_id")), "vec_id")


def dense_ip_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every given vector against all of them."""
    return _ranked(dense_top_k(_embeddings(spark, sf_dir, "qid"), _embeddings(spark, sf_dir, "doc_id"), K))


def dense_cells_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every given vector against all of them, through cells."""
    index = cells.write_cells(spark, _embeddings(spark, sf_dir, "doc_id"), scratch_path(spark, "cells"), CELLS)
    return _ranked(cells.cell_top_k(_embeddings(spark, sf_dir, "qid"), index, K).run)


def dense_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(cosine_top_k(_embeddings(spark, sf_dir, "qid"), _embeddings(spark, sf_dir, "doc_id"), K))


def dense_text_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded queries against encoded documents."""
    asked = testbed.encode_queries(spark, sf_dir, testbed.queries(spark, sf_dir))
    return _ranked(dense_top_k(asked, testbed.document_vectors(spark, sf_dir), K, testbed.DENSE))


def dense_beyond_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More places asked for than there are documents: every query gets all of them."""
    vectors = testbed.document_vectors(spark, sf_dir)
    asked = testbed.encode_queries(spark, sf_dir, testbed.queries(spark, sf_dir))
    run = dense_top_k(asked, vectors, vectors.count() + 1, testbed.DENSE)
    return run.groupBy("qid").agg(F.count("*").alias("places"), F.max("rank").cast("bigint").alias("last"))


def vector_dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors by dimension, against themselves as the query side."""
    return dimension_counts(_embeddings(spark, sf_dir, "doc_id"), _embeddings(spark, sf_dir, "qid"))


def vector_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All given vectors as index and as queries, with those of odd labels cut to half on the query side and
    those of label 3 left without their last number in the index: the rows that do not fit."""
    vectors = testbed.table(spark, sf_dir, "embeddings")
    size = F.size("embedding")
    short = F.when(F.col("label") % 2 == 1, F.slice("embedding", F.lit(1), (size / 2).cast("int"))).otherwise(F.col("embedding"))
    less = F.when(F.col("label") == 3, F.slice("embedding", F.lit(1), size - 1)).otherwise(F.col("embedding"))
    return mismatches(
        vectors.select(F.col("vec_id").alias("doc_id"), less.alias("embedding")),
        vectors.select(F.col("vec_id").alias("qid"), short.alias("embedding")),
    )


# Fusion


def rrf_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_to(fusion.contributions(testbed.runs(spark, sf_dir)), "contribution", 9)


def _rounded_to(df: DataFrame, name: str, digits: int) -> DataFrame:
    return df.withColumn(name, F.round(name, digits))


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_to(fusion.fuse(testbed.runs(spark, sf_dir)), "score", 9)


def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side made heavy in turn."""
    parts = []
    for bm25, dense in ((10.0, 0.1), (0.1, 10.0)):
        config = HybridConfig(bm25_weight=bm25, dense_weight=dense)
        run = fusion.rrf_top_k(testbed.runs(spark, sf_dir), K, config)
        parts.append(_ranked(run.withColumn("bm25_weight", F.lit(bm25)), "bm25_weight"))
    return parts[0].unionByName(parts[1])


def rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(fusion.rrf_top_k(testbed.runs(spark, sf_dir), K))


def rrf_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion to a depth of 150, each side read twice as deep."""
    asked = testbed.queries(spark, sf_dir)
    return _ranked(HybridRetriever(**testbed.retrievers(spark, sf_dir)).retrieve(asked, DEEP_K))


def rrf_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first places of the fusion of whole lists, certain by bounds."""
    asked = testbed.queries(spark, sf_dir)
    return _ranked(certified.certified_top_k(testbed.retrievers(spark, sf_dir), asked, K).run)


# Evaluation


def metrics_none_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled document as a query that finds itself: judged, but relevant only if it is good."""
    labels = testbed.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid"), "doc_id", "quality")
    scored = labels.withColumnRenamed("quality", "score")
    run = labels.select("qid", "doc_id").distinct().withColumn("rank", F.lit(1))
    return _rounded(metrics.mean_metrics(scored, run, datasets.binary_qrels(scored), KS, ("self",), scored), "value")


def metrics_no_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for queries that nobody judged: all metrics are there, and 0."""
    run = testbed.runs(spark, sf_dir)["bm25"].withColumn("qid", -1 - F.col("qid"))
    asked = run.select("qid").distinct()
    return metrics.mean_metrics(asked, run, testbed.qrels(spark, sf_dir), KS, ("bm25",))


def split_addressing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two splits of judgments below one dataset; the one that is named is read."""
    base = scratch_path(spark, "dataset")
    labels = testbed.table(spark, sf_dir, "labels")
    for split, column in (("test", "quality"), ("dev", "toxic")):
        named = DatasetConfig(base_dir=base, name="testbed", split=split)
        labels.select(
            F.lit(split).alias("query-id"), F.col("doc_id").cast("string").alias("corpus-id"), F.col(column).alias("score")
        ).write.csv(datasets.qrels_path(named), sep="\t", header=True)
    return datasets.read_qrels(spark, datasets.qrels_path(DatasetConfig(base_dir=base, name="testbed", split="dev")))


def _bm25_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = testbed.runs(spark, sf_dir)["bm25"]
    judged = testbed.qrels(spark, sf_dir)
    return metrics.query_metrics(eligible_queries(spark, sf_dir), run, judged, KS)


def _by_query(metric: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _bm25_by_query(spark, sf_dir).select("qid", "k", F.round(metric, DIGITS).alias("value"))

    return query


def eval_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How good BM25 is on the judged passages: mean metrics in long form."""
    asked = eligible_queries(spark, sf_dir)
    run = lexical.bm25_top_k(testbed.text_index(spark, sf_dir), asked, K)
    return _rounded(metrics.mean_metrics(asked, run, testbed.qrels(spark, sf_dir), KS, ("bm25",)), "value")


def _evaluation(spark: SparkSession, sf_dir: str):
    return testbed._once(
        spark,
        sf_dir,
        "evaluation",
        lambda: evaluate(
            testbed.retrievers(spark, sf_dir),
            testbed.queries(spark, sf_dir),
            testbed.qrels(spark, sf_dir),
            config=EvalConfig(dataset="testbed"),
        ),
    )


def eval_all_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_evaluation(spark, sf_dir).metrics, "value")


def metrics_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.to_wide(_evaluation(spark, sf_dir).metrics, KS), *metrics.metric_names(KS))


def avg_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.average_latency_ms(testbed.timings(spark, sf_dir)), "avg_latency_ms")


# Reports


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured metrics. Measured times differ from run to run, so the latency is left at 0 here."""
    found = _evaluation(spark, sf_dir)
    table = report.method_table(metrics.to_wide(found.metrics, KS), found.latency.limit(0))
    return _rounded(table, *metrics.metric_names(KS), report.LATENCY)


def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV and read back."""
    path = scratch_path(spark, "report-csv")
    table = _table(spark, sf_dir)
    reports.write_csv(table, path)
    return spark.read.schema(table.schema).csv(path, header=True)


def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as Markdown; the rows of its table read back as text cells."""
    path = scratch_path(spark, "report-md")
    reports.write_markdown(_table(spark, sf_dir), path)
    cells = F.split(F.trim(F.btrim("value", F.lit("|"))), r"\s*\|\s*")
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\| (bm25|dense|hybrid) \| \d+\.\d"))
    return lines.select(cells[0].alias("method"), F.array_join(F.slice(cells, 2, 100), " ").alias("cells"))


def report_one_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report on one method alone."""
    found = evaluate(
        testbed.retrievers(spark, sf_dir),
        testbed.queries(spark, sf_dir),
        testbed.qrels(spark, sf_dir),
        method="bm25",
        config=EvalConfig(dataset="testbed"),
    )
    table = report.method_table(metrics.to_wide(found.metrics, KS), found.latency.limit(0))
    return _rounded(table, *metrics.metric_names(KS))


def method_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir)


def method_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as an indented JSON document and read back."""
    path = scratch_path(spark, "report-json")
    reports.write_json(_table(spark, sf_dir), EvalConfig(dataset="testbed"), path)
    return reports.read_report(spark, path)


def summary_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary_columns(_table(spark, sf_dir))


def best_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.best_method(_table(spark, sf_dir))


def method_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.method_wins(_table(spark, sf_dir))


def fastest_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of event with the lowest mean, from the timing table."""
    return report.fastest_method(avg_latency(spark, sf_dir))


def chart_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.chart_table(_table(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "corpus_jsonl": corpus_jsonl,
    "corpus_rejects": corpus_rejects,
    "queries_jsonl": queries_jsonl,
    "qrels_tsv": qrels_tsv,
    "qrels_binary": qrels_binary,
    "qrels_from_passages": qrels_from_passages,
    "text_index_roundtrip": text_index_roundtrip,
    "text_index_upsert": text_index_upsert,
    "text_index_segments": text_index_segments,
    "vector_index_roundtrip": vector_index_roundtrip,
    "doc_text_compose": doc_text_compose,
    "eligible_queries": eligible_queries,
    "sample_queries": sample_queries,
    "sample_by_ordinal": sample_by_ordinal,
    "tokenize_terms": tokenize_terms,
    "term_frequency": term_frequency,
    "doc_lengths": doc_lengths,
    "field_stats": field_stats,
    "term_idf": term_idf,
    "content_idf": content_idf,
    "query_terms": query_terms,
    "bm25_single_field": bm25_single_field,
    "bm25_multi_field": bm25_multi_field,
    "bm25_topk": bm25_topk,
    "bm25_field_boost": bm25_field_boost,
    "bm25_segments": bm25_segments,
    "query_cost": query_cost,
    "hash_embed_docs": hash_embed_docs,
    "encoder_hook": encoder_hook,
    "encoder_batches": encoder_batches,
    "rerank_topk": rerank_topk,
    "l2_normalize": l2_normalize,
    "dense_ip_topk": dense_ip_topk,
    "dense_cells_topk": dense_cells_topk,
    "dense_cosine_topk": dense_cosine_topk,
    "dense_text_topk": dense_text_topk,
    "dense_beyond_corpus": dense_beyond_corpus,
    "vector_dim_check": vector_dim_check,
    "vector_mismatches": vector_mismatches,
    "rrf_contribution": rrf_contribution,
    "rrf_fuse": rrf_fuse,
    "rrf_weighted": rrf_weighted,
    "rrf_topk": rrf_topk,
    "rrf_deep": rrf_deep,
    "rrf_exact": rrf_exact,
    "recall_at_k": _by_query("recall"),
    "precision_at_k": _by_query("precision"),
    "mrr_at_k": _by_query("mrr"),
    "dcg_at_k": _by_query("dcg"),
    "idcg_at_k": _by_query("idcg"),
    "ndcg_at_k": _by_query("ndcg"),
    "metrics_none_relevant": metrics_none_relevant,
    "metrics_no_overlap": metrics_no_overlap,
    "split_addressing": split_addressing,
    "eval_run": eval_run,
    "metrics_wide": metrics_wide,
    "eval_all_methods": eval_all_methods,
    "avg_latency": avg_latency,
    "method_report": method_report,
    "method_report_json": method_report_json,
    "report_csv": report_csv,
    "report_markdown": report_markdown,
    "report_one_method": report_one_method,
    "summary_columns": summary_columns,
    "best_method": best_method,
    "method_wins": method_wins,
    "fastest_method": fastest_method,
    "chart_table": chart_table,
}
