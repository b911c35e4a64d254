import time

import numpy as np

from rankloom.llm import language_id, queries
from rankloom.session import materialise

SCHEMA = "doc_id long, text string, lang string"


def test_held_out_accuracy(spark, data_dir):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    rows = queries.op6_language_id(spark, data_dir).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert 40 < len(held) < 100
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def brute_bundle(text, dim, seed):
    """The method word for word: bind the permuted vectors of every n-gram and add them up."""
    letters = language_id.Letters(dim, seed)
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    kept = f" {' '.join(kept.split())} "
    total = np.zeros(dim)
    for k in range(len(kept) - 2):
        a, b, c = (letters.vector(ord(x)).astype(float) for x in kept[k : k + 3])
        total += np.roll(a, 2) * np.roll(b, 1) * c
    return total / np.linalg.norm(total)


def test_bundles_are_sums_of_bound_vectors():
    texts = ["Hello, world 42 times", "é", "ab" * 700 + " ñandú", "x", "½a²b"]
    found = language_id.bundle([*texts, None, "", "123", "½ ²"], language_id.Letters(256, 7))
    for row, text in zip(found, texts, strict=False):
        assert np.allclose(row, brute_bundle(text, 256, 7), atol=1e-6)
    assert not found[5:].any()


def test_vectors_are_balanced_and_unlike():
    letters = language_id.Letters()
    vectors = np.array([letters.vector(c) for c in range(97, 123)], dtype=float)
    cosines = vectors @ vectors.T / language_id.DIM
    assert np.allclose(np.diag(cosines), 1) and np.abs(cosines - np.eye(26)).max() < 0.2


def test_many_languages_in_passes_and_odd_rows(spark, prose, monkeypatch):
    alphabets = ["abcdef", "ghijkl", "mnopqr", "stuvwx", "αβγδεζ"]
    rows = []
    for k, letters in enumerate(alphabets):
        for n in range(8):
            source = np.random.default_rng(100 * k + n)
            words = ["".join(source.choice(list(letters), 4)) for _ in range(40)]
            rows.append((100 * k + n, " ".join(words), f"l{k}"))
    rows += [(900, None, "l0"), (901, "12 !!", "l1"), (902, "abc fed", None), (903, "", "empty")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    learned = materialise(language_id.learn(docs), "learned")
    assert {r["lang"] for r in learned.select("lang").distinct().collect()} == {"l0", "l1", "l2", "l3", "l4", "empty"}
    once = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, learned).collect()}
    monkeypatch.setattr(language_id, "LANGS_PER_PASS", 2)
    passes = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, learned).collect()}
    assert once == passes
    assert all(once[k][0] == lang for k, text, lang in rows if k < 900)
    assert once[900] == once[901] == once[903] == ("und", 0.0) and once[902][0] == "l0"


def test_repeats_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "abc", "x", 5), (1, "abc", "x", 5), (2, None, None, 5)], SCHEMA + ", SCORE int")
    learned = materialise(language_id.learn(docs), "learned")
    rows = language_id.predict(docs, learned)
    assert rows.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert sorted((r.doc_id, r.lang_pred) for r in rows.collect()) == [(1, "x"), (1, "x"), (2, "und")]
    nothing = materialise(language_id.learn(docs.limit(0)), "learned")
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), learned).collect() == []


def test_the_largest_of_negative_cosines_wins(spark, monkeypatch):
    texts = ["qxz", None]
    unit = language_id.bundle(texts[:1], language_id.Letters())[0]
    other = np.roll(unit, 1) - (np.roll(unit, 1) @ unit) * unit
    vectors = {"a": -unit, "b": 3 * other - unit, "und": 2 * other - unit}
    learned = spark.createDataFrame(
        [(lang, k, int(1e9 * x)) for lang, v in vectors.items() for k, x in enumerate(v)], "lang string, place int, value long"
    )
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for per_pass in (256, 1):
        monkeypatch.setattr(language_id, "LANGS_PER_PASS", per_pass)
        found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, learned).collect()}
        assert found == {0: ("b", 0.0), 1: ("und", 0.0)}


def test_prototypes_and_predictions_by_brute_force(spark):
    source = np.random.default_rng(3)
    rows = []
    for k, letters in enumerate(["abcdef", "defghi", "αβγab"]):
        rows += [
            (10 * k + n, " ".join("".join(source.choice(list(letters), 3)) for _ in range(5 + n)), f"l{k}")
            for n in range(6)
        ]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    learned = materialise(language_id.learn(docs, dim=128, seed=3), "learned")
    sums = {}
    for _, text, lang in rows:
        sums[lang] = sums.get(lang, 0) + brute_bundle(text, 128, 3)
    for lang, total in sums.items():
        found = {r.place: r.value for r in learned.where(f"lang = '{lang}'").collect()}
        assert np.allclose([found[k] / 1e9 for k in range(128)], total, atol=1e-5)
    names = sorted(sums)
    unit = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    for r in language_id.predict(docs, learned, dim=128, seed=3).collect():
        cosines = unit @ brute_bundle(r.text, 128, 3)
        assert r.lang_pred == names[int(np.argmax(cosines))]
        assert abs(r.score - max(0, cosines.max())) < 2e-5


def test_equal_cosines_go_to_the_smaller_name(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "ab cd", "z"), (2, "ab cd", "b"), (3, "ab cd", "m")], SCHEMA)
    learned = materialise(language_id.learn(docs), "learned")
    for per_pass in (256, 1):
        monkeypatch.setattr(language_id, "LANGS_PER_PASS", per_pass)
        assert {r.lang_pred for r in language_id.predict(docs, learned).collect()} == {"b"}


def test_a_very_long_text_in_blocks_and_in_time(monkeypatch):
    text = "Ab, ½c dé\n" * 200_000
    language_id.grams("warm")
    start = time.process_time()
    codes, counts = language_id.grams(text)
    # Looking letters up takes a small part of a microsecond each; a list in a pattern took ten times that.
    assert time.process_time() - start < 0.5e-6 * len(text)
    short, few = language_id.grams("Ab, ½c dé\n" * 2)
    assert set(codes) == set(short) and counts.sum() == len(" ab c dé") * 200_000 - 1
    monkeypatch.setattr(language_id, "BLOCK_CHARS", 7)
    again = language_id.grams("Ab, ½c dé\n" * 2)
    assert (again[0] == short).all() and (again[1] == few).all()
