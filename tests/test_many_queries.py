"""More judged queries than any sample, with passages of one and two words, against the SQL."""

import random

import duckdb
import pandas as pd
import pytest

from rankloom.plans.oracle import SQL
from rankloom.plans.registry import QUERIES


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    source = random.Random(7)
    vocabulary = ["".join(source.choice("abcdefgh") for _ in range(source.randint(2, 4))) for _ in range(400)]
    texts = [" ".join(source.choice(vocabulary) for _ in range(source.randint(5, 40))) for _ in range(240)]
    passages = []
    for k in range(230):
        words = texts[k].split()
        size = (1, 2, 3, 12)[k % 4]
        start = source.randrange(max(1, len(words) - size))
        passages.append(" ".join(words[start : start + size]))
    passages += ["", "don't", "..."]
    texts += ["I don't know", "it's 3.14"]
    path = tmp_path_factory.mktemp("many")
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": ["title\n" + t if k % 3 else t for k, t in enumerate(texts)]})
    documents.to_parquet(path / "documents.parquet", index=False)
    pd.DataFrame({"item_id": range(len(passages)), "text": passages}).to_parquet(path / "benchmark.parquet", index=False)
    return str(path)


@pytest.mark.parametrize("name", ["qrels_from_passages", "eval_all_methods", "method_report", "metrics_wide"])
def test_agrees_with_sql(spark, folder, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    frame = QUERIES[name](spark, folder)
    theirs = db.execute(SQL[name]).df()
    mine = frame.toPandas()[list(theirs.columns)]
    keys = [c for c in theirs.columns if theirs[c].dtype == object or c in ("qid", "doc_id", "k", "metric", "method")]
    mine, theirs = (f.sort_values(keys).reset_index(drop=True) for f in (mine, theirs))
    pd.testing.assert_frame_equal(mine, theirs, check_dtype=False, atol=2e-6)
    if name == "qrels_from_passages":
        assert mine.qid.nunique() > 220 and {0, 1} <= set(mine.qid)
