import random

import pytest
from pyspark.sql import Row

from rankloom.llm import queries, tokens

FILE = queries.tokenizer_path("byte_bpe_50k.json")
PARTS = ["a", "é", " ", "  ", "\n", "'s", "'ll", "'", "9", "12", "<|endoftext|>", "<|", "|>", "!", "日本", "\t ", "the ", " word", "👩‍👧"]


def whole(text):
    return len(tokens.tokenizer(FILE).encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize(("chunk", "overlap"), [(200, 20), (150, 66), (300, 8), (1000, 500)])
def test_chunks_count_as_the_whole(chunk, overlap):
    source = random.Random(chunk)
    for _ in range(120):
        text = "".join(source.choice(PARTS) for _ in range(source.randint(1, 900)))
        assert tokens.count_in_chunks(tokens.tokenizer(FILE), text, chunk, overlap) == whole(text)


@pytest.mark.parametrize(
    "text", ["a" * 5000, " " * 5000, "é" * 3000, "<|endoftext|>" * 400, "<|endoftext" * 400, "ab " * 2000, "'ll" * 2000, "7" * 999]
)
def test_runs_without_a_boundary(text):
    assert tokens.count_in_chunks(tokens.tokenizer(FILE), text, 500, 50) == whole(text)


def test_whole_table(spark, data_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    rows = queries.op2_token_counts(spark, data_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_tokens == whole(texts[r.doc_id]) and r.n_bytes == len(texts[r.doc_id].encode())
        assert r.over_limit == (r.n_tokens > 512)


def test_odd_rows(spark, prose):
    long = prose(30_000, 1) + "<|endoftext|>" + "x" * 50_000
    texts = [None, "", "", "é<|endoftext|>é", " ", long]
    docs = spark.createDataFrame([Row(k // 2, t, "was") for k, t in enumerate(texts)], "doc_id long, text string, N_TOKENS string")
    found = tokens.count_tokens(docs, FILE)
    assert found.columns == ["doc_id", "text", *tokens.RESULTS]
    assert sorted((r.n_bytes, r.n_tokens) for r in found.collect()) == sorted(
        (len((t or "").encode()), whole(t)) for t in texts
    )
    assert tokens.count_tokens(docs.limit(0), FILE).collect() == []
