import collections

from pathlib import Path

import pytest

import corpus_pipeline as pipeline
from rankloom.llm.common import table
from rankloom.session import materialise, scratch_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_the_whole_table(spark, data_dir):
    """Every stage against what its operator says of the stage's own input."""
    from test_decontaminate import brute as contaminated
    from test_ngram_join import brute as linked

    docs = table(spark, data_dir, "documents")
    seen = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, data_dir), name.replace(" ", "-"))
        seen[name] = (before.collect(), docs.collect())
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    before, after = seen["quality classifier"]
    marks = {r.doc_id: r.quality for r in table(spark, data_dir, "labels").collect()}
    kept = {r.doc_id for r in after}
    good = [r.doc_id for r in before if marks.get(r.doc_id) == 1]
    assert sum(k in kept for k in good) >= 0.97 * len(good) and len(after) < len(before)

    before, after = seen["n-gram Jaccard join"]
    groups = {k: c for k, (_, c) in linked([(r.doc_id, r.text) for r in before]).items()}
    assert sorted(r.doc_id for r in after) == sorted(set(groups.values()))

    before, after = seen["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, data_dir, "benchmark").collect()]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not contaminated(r.text, items)[-1])

    before, after = seen["mixing sources"]
    drawn = collections.Counter(r.doc_id for r in after)
    assert set(drawn) <= {r.doc_id for r in before} and max(drawn.values()) <= 2
    words = {r.doc_id: len(r.text.split()) for r in before}
    assert sum(words[k] * n for k, n in drawn.items()) > 1.2 * sum(words.values())

    before, after = seen["sharding"]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)
    assert {r.shard for r in after} <= set(range(40)) and "shard" in docs.columns


def test_run_is_the_stages_one_after_the_other(spark, data_dir):
    rows = pipeline.run(spark, data_dir)
    assert rows.columns[:5] == COLUMNS and rows.count() > 0


def test_an_empty_table_runs_through(spark, data_dir):
    docs = table(spark, data_dir, "documents").limit(0)
    for name, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, data_dir), name.replace(" ", "-"))
        assert docs.count() == 0


@pytest.fixture()
def odd_folder(spark, prose, tmp_path):
    """Nulls, empty and very long texts, repeated rows, ties, and columns named as the operators name theirs."""
    rows = [(k, prose(40 + k % 7, k), "en", f"s{k % 3}", 1, f"score{k}", k, "h", 5) for k in range(90)]
    rows += [(100 + k, "*** ### " * 30, "en", "s1", 1, "bad", k, "h", 5) for k in range(30)]
    rows += [(200, prose(90_000, 5), None, None, None, None, None, None, None), (201, None, None, "s2", None, None, None, None, None)]
    rows += [(202, "", "en", None, 0, "empty", 1, "h", 5), (None, "lone words here", None, None, None, None, None, None, None)]
    rows += [rows[3]] * 3 + [(300, rows[4][1], "en", "s9", 1, "copy of 4", 1, "h", 5)]
    rows += [(301, prose(20, 7000) + " " + prose(30, 8000), "en", "s1", 1, "leak", 1, "h", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, SCORE string, copies int, hits string, Shard int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(k, 1, 0) for k in range(90)] + [(100 + k, 0, 0) for k in range(30)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(30, 8000)), (2, None), (3, "")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    return str(tmp_path)


def test_odd_rows_keep_their_columns(spark, odd_folder):
    docs = table(spark, odd_folder, "documents")
    columns, before = docs.columns, {(r.doc_id, r.SCORE): tuple(r) for r in docs.collect()}
    held = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, odd_folder), name.replace(" ", "-"))
        assert docs.columns == columns
        rows = docs.collect()
        assert all(tuple(r) == before[r.doc_id, r.SCORE] for r in rows)
        held[name] = [r.doc_id for r in rows]
    first, single, clean, mixed = held.values()
    assert not [k for k in first if k is not None and 100 <= k < 130] and {3, 200, 201, 301} <= set(first)
    assert collections.Counter(single)[3] == 1 and 300 not in single and 4 in single and {200, 201, None} <= set(single)
    assert set(single) - set(clean) == {301} and set(mixed) <= set(clean)
    name, stage = pipeline.STAGES[-1]
    last = stage(spark, docs, odd_folder)
    assert last.columns[: len(columns) - 1] == [c for c in columns if c != "Shard"]
    assert sorted(map(repr, (r.doc_id for r in last.collect()))) == sorted(map(repr, mixed))


def test_a_run_leaves_little_behind(spark, odd_folder):
    folder = Path(scratch_dir(spark).removeprefix("file://").removeprefix("file:")) / "rankloom"
    before = set(folder.iterdir()) if folder.exists() else set()
    assert pipeline.run(spark, odd_folder).count() > 0
    left = sorted(p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before)
    # The input of the last stage, its map and the sizes it was made from.
    assert left == ["mixing-sources", "shard-map", "slot-sizes"] or set(left) <= {"mixing-sources", "shard-map", "slot-sizes", "large-slots"}
