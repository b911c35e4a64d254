"""The queries that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankloom.llm import (
    collocations,
    decontaminate,
    embedding_dedup,
    language_id,
    license_scan,
    line_dedup,
    mixing,
    ngram_join,
    oracle,
    quality,
    sharding,
    token_alignment,
    tokens,
    url_filter,
)
from rankloom.llm.common import table
from rankloom.session import materialise, scratch_path

SHARDS = 40


def tokenizer_path(name: str) -> str:
    """Where the tokenizer files of the installed package lie, on the driver as on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)

# A page is listed if its html holds at least so many runs of three equal marks.
MARKS = r"%%%|\*\*\*|###|\$\$\$|&amp;&amp;&amp;"
MARKED = 10


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mixing.cycled_weights(docs, (3, 1, 2)), share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"), limit=512)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dealt = sharding.shard(docs, SHARDS, scratch_path(spark, "shard-map"))
    return dealt.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(table(spark, sf_dir, "embeddings"))


def fold(folds: int) -> Column:
    """Fold of a document by the check sum of its id as text; a null id is in fold 0."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(fold(5) != 0))
    scored = quality.score(docs.select("doc_id", "text"), model, threshold=0.3)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = materialise(language_id.learn(docs.where(fold(3) != 1)), "language-prototypes")
    predicted = language_id.predict(docs.select("doc_id", "text"), learned)
    return predicted.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


def listed_urls(pages: DataFrame) -> DataFrame:
    """The urls of pages that were found bad when they were read: full of runs of marks, whatever their host.

    The test tables bring no list of their own. A page without html is not listed by itself.
    """
    return pages.where(F.regexp_count("html", F.lit(MARKS)) >= MARKED).select("url")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = url_filter.judge(pages, listed_urls(pages), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "listed")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join.join(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "class_id", "n_links", "component_id", "kept")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # The ranks are the vocabulary of byte_bpe_50k.json; the tests hold both against each other.
    files = token_alignment.Files(
        tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"), public_tokenizers.PATTERN
    )
    return token_alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), files)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_sharding": op3_sharding,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_quality": op5_quality,
    "op6_language_id": op6_language_id,
    "op7_url_filter": op7_url_filter,
    "op8_decontaminate": op8_decontaminate,
    "op9_license_scan": op9_license_scan,
    "op10_ngram_join": op10_ngram_join,
    "op11_line_dedup": op11_line_dedup,
    "op12_collocations": op12_collocations,
    "op13_token_alignment": op13_token_alignment,
}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return dict(oracle.SQL)
