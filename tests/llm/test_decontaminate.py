import hashlib
import random
import re

import pytest

from rankloom.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def brute(text, items, window=10):
    words, hit, names = words_of(text), set(), set()
    for item, body in items:
        tested = words_of(body)
        size = min(window, len(tested))
        grams = {tuple(tested[k : k + size]) for k in range(len(tested) - size + 1)} if size else set()
        for k in range(len(words) - size + 1):
            if size and tuple(words[k : k + size]) in grams:
                hit |= set(range(k, k + size))
                names.add(str(item))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(words), len(hit), len(names), digest, bool(hit)


def scan(spark, docs, items, **more):
    found = decontaminate.scan(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **more)
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()}


@pytest.mark.parametrize("slice_bytes", [1 << 20, 400])
def test_against_brute_force(spark, prose, slice_bytes):
    source = random.Random(5)
    items = [(k, prose(source.choice([1, 3, 9, 10, 11, 40]), k)) for k in range(30)]
    items += [(100, items[5][1]), (101, "a a a a a a a a a a a"), (9, "a b"), (102, None), (103, ""), (104, "...")]
    docs = []
    for k in range(120):
        words = prose(source.randint(0, 80), 1000 + k).split()
        for _ in range(source.randint(0, 3)):
            planted = (source.choice(items)[1] or "").split()
            start = source.randint(0, max(0, len(planted) - 10))
            place = source.randint(0, len(words))
            words[place:place] = planted[start : start + source.choice([9, 10, 12, 50])]
        docs.append((k, " ".join(words).upper() if k % 2 else "\n".join(words)))
    docs += [(200, None), (201, ""), (202, "a " * 500), (203, "A. b? a, B"), (204, "é" * 100)]
    found = scan(spark, docs, items, slice_bytes=slice_bytes)
    assert found == {k: brute(t, items) for k, t in docs}


def test_repeating_patterns_are_found_at_every_place():
    """Wu-Manber must not jump over overlapping occurrences."""
    tables = decontaminate.build([("x", b"a b a b a b a b a b a b"), ("y", b"b a")])
    words = [b"a", b"b"] * 12
    found = sorted(start for patterns in tables if patterns.length == 10 for start, _ in patterns.search(words))
    assert found == list(range(15))


def test_repeats_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", 3, "q"), (1, "a b c", 3, "q"), (None, "a", 1, "q")], DOCS + ", N_Hit int, state string")
    items = spark.createDataFrame([(7, "b c"), (7, "b c"), (None, "a b")], ITEMS)
    rows = decontaminate.scan(docs, items)
    assert rows.columns == ["doc_id", "text", "state", *decontaminate.RESULTS]
    found = rows.collect()
    assert [(r.n_hit, r.n_items) for r in found if r.doc_id == 1] == [(3, 2)] * 2
    assert [(r["start"], r["end"]) for r in found[0].hits] == [(0, 3)] and found[0].state == "q"
    assert decontaminate.scan(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.scan(docs.limit(0), items).collect() == []


def test_many_slices_never_write_texts(spark, prose, monkeypatch):
    items = [(k, prose(15, k)) for k in range(60)]
    docs = [(k, f"{prose(20, 500 + k)} {items[k % 60][1] if k % 3 == 0 else ''} {prose(20, 900 + k)}") for k in range(150)]
    docs += [(1000 + k, items[7][1] + " " + items[8][1]) for k in range(40)] + [(5000, None)]
    size = sum(len(t) + len(str(k)) for k, t in items)
    written, plain = [], decontaminate.materialise

    def noted(df, label):
        written.append(set(df.columns))
        return plain(df, label)

    monkeypatch.setattr(decontaminate, "materialise", noted)
    found = scan(spark, docs, items, slice_bytes=size // 20)
    assert found == {k: brute(t, items) for k, t in docs}
    assert len(written) >= 20 and all(columns <= {"row1", "row2", "copies", "state"} for columns in written)


def test_a_very_long_text_and_ties(spark, prose):
    items = [("same", prose(12, 1)), ("same", prose(12, 1)), ("other", prose(12, 1))]
    long = prose(60_000, 3) + " " + items[0][1] + " " + prose(60_000, 4)
    docs = spark.createDataFrame([(1, long)], DOCS)
    row = decontaminate.scan(docs, spark.createDataFrame(items, "item_id string, text string")).first()
    assert (row.n_words, row.n_hit, row.n_items, row["items"]) == (120_012, 12, 2, ["other", "same"])
