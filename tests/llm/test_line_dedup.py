import random
from collections import defaultdict

import pytest

from rankloom.llm import line_dedup
from rankloom.llm.line_dedup import Settings


def brute(docs, settings):
    """(n_lines, n_dropped, kept) of every (id, text), by plain counting."""
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = defaultdict(set)

    def key(line):
        return line.strip(strip).translate(lower)

    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= settings.min_chars:
                holders[key(line)].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            held = holders.get(key(line), set())
            last = max(held, key=lambda d: (d is not None, d or 0)) if held else None
            if len(held) < settings.min_docs or doc == last:
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in frame.collect()), key=repr)


def corpus(seed, n, with_odd=True):
    source = random.Random(seed)
    pool = ["short", "", "  ", "Être été à l'école, naïveté", "x" * 9, "é" * 10, "Ab Cd Ef Gh Ij", "kelvin K sign 1"]
    pool += [f"Line number {k} of some length" for k in range(12)]
    docs = []
    for k in range(n):
        lines = []
        for _ in range(source.randint(1, 9)):
            line = source.choice(pool)
            line = line.upper() if source.random() < 0.2 and line.isascii() else line
            lines.append(source.choice(["", " ", "\t", "\x0b", " "]) + line + source.choice(["", "\r", " \x0c"]))
        docs.append((k, "\n".join(lines)))
    if with_odd:
        docs += [(None, "Line number 1 of some length"), (None, None), (7, "Line number 1 of some length\n\n"), (n + 1, ""), (n + 2, None)]
        docs += [docs[3]] * 4
    return docs


@pytest.mark.parametrize(("min_chars", "min_docs"), [(10, 5), (10, 2), (1, 3), (30, 5), (0, 5)])
def test_as_by_counting(spark, min_chars, min_docs):
    docs = corpus(min_chars, 60)
    settings = Settings(min_chars, min_docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows_of(line_dedup.drop_lines(frame, settings)) == brute(docs, settings)


def test_hot_and_rare_keys_and_slices_of_equal_rows(spark, monkeypatch):
    docs = corpus(4, 80) + [(5000, "Line number 3 of some length\nown")] * 40
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    expected = brute(docs, Settings(10, 3))
    for hot, rows, block in ((1, 1 << 14, 3), (8, 5, 1 << 16), (1 << 16, 1, 1)):
        monkeypatch.setattr(line_dedup, "HOT_KEYS", hot)
        monkeypatch.setattr(line_dedup, "SLICE_ROWS", rows)
        monkeypatch.setattr(line_dedup, "BLOCK_LINES", block)
        assert rows_of(line_dedup.drop_lines(frame, Settings(10, 3))) == expected


def test_a_tie_of_ids_keeps_both_rows(spark):
    line = "the same line of more than ten characters"
    docs = [(k, line) for k in range(4)] + [(9, line + "\na"), (9, "b\n" + line)]
    found = rows_of(line_dedup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")))
    assert [r[2] for r in found] == [1, 1, 1, 1, 0, 0] and found[0][3] == ""


def test_very_long_texts(spark):
    line = "a line that is shared by all of these documents"
    body = "\n".join(f"line {k} of a very long text, all on its own here" if k % 3 else line for k in range(60_000))
    docs = [(k, body if k == 2 else line + "\n" + "x" * 200_000) for k in range(6)]
    found = line_dedup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows_of(found) == brute(docs, Settings())


def test_clashing_names_other_keys_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [("a", "same line", {"k": 1}, "x", 5, 6, 7), ("b", "same line", None, None, 5, 6, 7), ("b", None, None, "y", 5, 6, 7)],
        "id string, body string, more map<string,int>, KEPT string, row1 int, possible int, number int",
    )
    found = line_dedup.drop_lines(docs, Settings(1, 2), key="id", text="body")
    assert found.columns == ["id", "body", "more", "row1", "possible", "number", *line_dedup.RESULTS]
    rows = sorted((r.id, r.body or "", r.more, r.row1, r.n_lines, r.n_dropped, r.kept) for r in found.collect())
    assert rows == [("a", "same line", {"k": 1}, 5, 1, 1, ""), ("b", "", None, 5, 1, 0, ""), ("b", "same line", None, 5, 1, 0, "same line")]
    assert line_dedup.drop_lines(docs.limit(0), key="id", text="body").collect() == []
