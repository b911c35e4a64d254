import collections
import math
import re

import pytest
from pyspark.sql import Row

from rankloom.llm import mixing, queries

SCHEMA = "doc_id long, text string, source string"


def filled(sizes, weights, share=1.5, cap=2.0):
    """Targets by resharing the excess again and again."""
    capped, total = set(), share * sum(sizes.values())
    while True:
        free = total - sum(cap * sizes[s] for s in capped)
        open_weight = sum(w for s, w in weights.items() if s not in capped)
        targets = {s: cap * sizes[s] if s in capped else free * weights[s] / open_weight for s in sizes}
        above = {s for s in sizes if s not in capped and targets[s] > cap * sizes[s]}
        if not above:
            return targets
        capped |= above


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_taken_on_the_whole_table(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").collect()
    rows = {r.doc_id: r for r in queries.op1_mixing(spark, data_dir).collect()}
    assert len(rows) == len(docs)
    sizes, largest = collections.Counter(), collections.Counter()
    for d in docs:
        assert rows[d.doc_id].size == size_of(d.text)
        sizes[d.source] += size_of(d.text)
        largest[d.source] = max(largest[d.source], size_of(d.text))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}
    targets = filled(sizes, weights)
    taken = collections.Counter()
    for d in docs:
        row = rows[d.doc_id]
        assert row.source_size == sizes[d.source]
        assert row.target == pytest.approx(targets[d.source], rel=1e-9)
        assert row.taken == row.copies * row.size and row.taken <= 2 * row.size
        taken[d.source] += row.taken
    for source in sizes:
        assert abs(taken[source] - targets[source]) <= largest[source]
    again = {(r.doc_id, r.taken) for r in queries.op1_mixing(spark, data_dir).collect()}
    assert again == {(k, r.taken) for k, r in rows.items()}


def test_copies_follow_the_prefix_sum(spark, prose):
    """Brute force of the method: large to small, one offset, a copy per integer crossed."""
    rows = [(k, prose(1 + k % 37, k), "ab"[k % 2]) for k in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    weights = spark.createDataFrame([("a", 5.0), ("b", 1.0)], "source string, weight double")
    found = mixing.mix(docs, weights, share=1.2).collect()
    by_source = collections.defaultdict(list)
    for r in found:
        by_source[r.source].append(r)
    for source, members in by_source.items():
        rate = members[0].target / members[0].source_size
        classes = collections.defaultdict(list)
        for r in members:
            classes[f"{len(str(r.size)):02d}{str(r.size)[:2]:0<2}"].append(r.copies)
        total, offsets = 0, (0.0, 1.0)
        low, high = 0.0, 1.0
        for name in sorted(classes, reverse=True):
            drawn = sum(classes[name])
            total_before, total = total, total + len(classes[name])
            # floor(rate * total + u) is known for every class, which bounds the one offset u.
            done = sum(sum(classes[n]) for n in classes if n >= name)
            low, high = max(low, done - rate * total), min(high, done + 1 - rate * total)
            assert math.floor(rate * (total - total_before)) <= drawn <= math.ceil(rate * (total - total_before))
        assert low < high + 1e-9, (source, offsets)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (2, "", "a"), (3, " \t\n", "a"), (4, "x y z", "b"), (None, "w " * 5000, "b")]
    docs = spark.createDataFrame([Row(*r, 7, "old") for r in rows], SCHEMA + ", Size int, TARGET string")
    mixed = mixing.mix(docs, mixing.cycled_weights(docs))
    assert mixed.columns == ["doc_id", "text", "source", *mixing.RESULTS]
    found = {(r.doc_id, r.source): r for r in mixed.collect()}
    assert mixed.count() == 6
    assert found[(1, None)].size == 0 and found[(1, None)].target == 0 and found[(1, None)].taken == 0
    assert found[(4, "b")].size == 2 and found[(None, "b")].size == 5000
    assert found[(None, "b")].source_size == 5002 and found[(None, "b")].target == 1.5 * 5002
    assert {r.copies for r in mixed.where("source = 'a'").collect()} == {0}


def test_sources_without_weight_give_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "a b", "y"), (3, "a", "z")], SCHEMA)
    weights = spark.createDataFrame([("x", 1.0), ("x", 0.5), ("y", None), ("z", -1.0)], "source string, weight double")
    found = {r.source: (r.target, r.taken) for r in mixing.mix(docs, weights).collect()}
    assert found == {"x": (6.0, 6), "y": (0.0, 0), "z": (0.0, 0)}


def test_empty_table_and_emitted_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty, mixing.cycled_weights(empty)).collect() == []
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "x")], SCHEMA)
    mixed = mixing.mix(docs, mixing.cycled_weights(docs))
    drawn = mixing.emit(mixed).collect()
    assert len(drawn) == sum(r.copies for r in mixed.collect()) == 3


def test_hot_source_and_equal_sizes(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'a b c' AS text", "IF(id % 3 = 0, 'hot', concat('s', id % 40)) AS source")
    mixed = mixing.mix(docs, mixing.cycled_weights(docs))
    for row in mixed.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(row["sum(taken)"] - row["max(target)"]) <= 3


def test_a_row_repeated_very_often_is_numbered_in_parts(spark, prose, monkeypatch):
    """The copies of every kind of row are those of one pass over the whole order, for any partitions."""
    same = prose(12, 1)
    rows = [(1, same, "a")] * 3000 + [(2, same, "a")] * 40 + [(10 + k, prose(1 + k % 40, k), "ab"[k % 2]) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")

    def copies(parts, limit):
        monkeypatch.setattr(mixing, "PART_ROWS", limit)
        found = mixing.mix(docs.repartition(parts), weights, share=1.3, cap=2.0)
        return sorted((r.doc_id, r.copies, r.taken, round(r.target, 6)) for r in found.collect())

    whole = copies(3, 1 << 20)
    assert copies(3, 50) == copies(7, 50) == copies(2, 700) == whole
    assert sum(r[0] == 1 for r in whole) == 3000
    taken = sum(r[2] for r in whole)
    assert abs(taken - 1.3 * sum(len(t.split()) for _, t, _ in rows)) <= 2 * 40
