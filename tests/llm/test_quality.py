import math

import numpy as np
import pytest

from rankloom.llm import quality, queries
from rankloom.llm.quality import Settings


def test_held_out_accuracy(spark, tmp_path_factory):
    folder = "/root/testdata/sf0.01"
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op5_quality(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in marks]
    good, bad = [r for r in held if marks[r.doc_id]], [r for r in held if not marks[r.doc_id]]
    assert sum(r.predicted for r in good) >= 0.97 * len(good)
    assert sum(1 - r.predicted for r in bad) >= 0.8 * len(bad)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def bags(n, seed=0):
    random = np.random.default_rng(seed)
    found = [quality.features([[b"word%d" % random.integers(9) for _ in range(12)] for _ in range(1 + k % 5)]) for k in range(n)]
    return found, (np.arange(n) % 2).astype(float)


def test_gradients_are_those_of_the_log_loss():
    found, labels = bags(9)
    model = quality.fit(found, labels, Settings(epochs=1, hidden=4, attention=3))
    x, bag = np.concatenate(found), np.repeat(np.arange(9), [len(b) for b in found])

    def loss():
        p = model.score_bags(x, bag, 9)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for name, gradient in quality._gradients(model, x, bag, labels).items():
        weights = getattr(model, name)
        for at in list(np.ndindex(weights.shape))[:: max(1, weights.size // 7)]:
            kept, step = weights[at], 1e-5
            weights[at] = kept + step
            up = loss()
            weights[at] = kept - step
            down = loss()
            weights[at] = kept
            assert gradient[at] == pytest.approx((up - down) / (2 * step), abs=1e-6)


def test_attention_finds_the_one_bad_passage():
    """A document is bad for one bad passage among many good ones."""
    random = np.random.default_rng(8)

    def passage(bad):
        return [b"***" if bad else b"w%d" % random.integers(50) for _ in range(20)]

    texts = [[passage(k % 2 == 0 and p == k % 6) for p in range(6)] for k in range(300)]
    labels = np.array([float(k % 2) for k in range(300)])
    model = quality.fit([quality.features(t) for t in texts], labels, Settings(epochs=20))
    scores = np.array([model.score(t, 2) for t in texts])
    assert ((scores > 0.5) == (labels > 0.5)).mean() > 0.97
    h = model.encode(quality.features(texts[0]))
    assert model.attention(h).argmax() == 0


def test_running_sums_are_the_whole_softmax():
    found, labels = bags(20)
    model = quality.fit(found, labels, Settings(epochs=2))
    parts = [[b"a", b"b!"], [b"ccc"] * 5, [b"1", b"2"], [], [b"Z"] * 3]
    whole = model.score_bags(quality.features(parts), np.zeros(5, int), 1)[0]
    assert model.score(parts, 1) == pytest.approx(whole) == model.score(parts, 2) == pytest.approx(model.score(parts, 99))


def test_odd_rows(spark, prose):
    texts = [prose(60, k) for k in range(20)] + [("*** " * 60)] * 20 + [None, "", " \n", prose(80_000, 3)]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, Score int, raw string")
    marks = [(k, int(k < 20)) for k in range(40)] + [(None, 1), (7, None), (41, 3)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    model = quality.train(docs, labels)
    scored = quality.score(docs, model)
    assert scored.columns == ["doc_id", "text", "raw", "score", "predicted"]
    found = {r.doc_id: r for r in scored.collect()}
    assert len(found) == len(texts)
    assert all(found[k].predicted == int(k < 20) for k in range(40)) and found[43].predicted == 1
    assert found[40].score == found[41].score == found[42].score
    again = {r.doc_id: r.score for r in quality.score(docs.repartition(5), quality.train(docs.repartition(3), labels)).collect()}
    assert again == {k: r.score for k, r in found.items()}
    assert quality.score(docs.limit(0), model).collect() == []


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    one = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    assert quality.train(docs, one) == 0.0 and quality.train(docs, one.limit(0)) == 1.0
    assert {r.score for r in quality.score(docs, 0.0).collect()} == {0.0}
    assert quality.score(docs, 0.0).count() == 3


def test_the_sample_is_bounded(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'some words' AS text")
    labels = docs.selectExpr("doc_id", "IF(doc_id % 10 = 0, 0, 1) AS quality")
    settings = Settings(sample=400)
    sampled = quality.sample_labelled(docs, labels, settings, "text", "doc_id", "quality")
    counts = {r["label"]: r["count"] for r in sampled.groupBy("label").count().collect()}
    assert 150 < counts[0] < 260 and 150 < counts[1] < 260


def test_a_balanced_sample_scores_like_all_labels(spark):
    """Labels nine to one that the texts tell only in part: the share of label 1 must come through."""
    random = np.random.default_rng(4)
    rows = []
    for k in range(6000):
        good = int(k % 10 > 0)
        marked = random.random() < (0.4 if good else 0.7)
        rows.append((k, " ".join(["***" if marked else "word"] * int(random.integers(8, 30))), good))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    labels = docs.select("doc_id", "quality")
    every = quality.train(docs, labels, Settings(sample=20_000, epochs=15))
    some = quality.train(docs, labels, Settings(sample=1000, epochs=60))
    for word, share in (("word", 0.9 * 0.6 / (0.9 * 0.6 + 0.1 * 0.3)), ("***", 0.9 * 0.4 / (0.9 * 0.4 + 0.1 * 0.7))):
        part = [[word.encode()] * 20]
        assert every.score(part, 8) == pytest.approx(share, abs=0.06)
        assert some.score(part, 8) == pytest.approx(every.score(part, 8), abs=0.08)


def test_weighted_gradients_are_those_of_repeated_bags():
    found, labels = bags(6)
    model = quality.fit(found, labels, Settings(epochs=1, hidden=4, attention=3))
    counts = np.array([1, 2, 3, 1, 2, 3])
    twice = [k for k in range(6) for _ in range(counts[k])]

    def gradients(chosen, *weights):
        bag = np.repeat(np.arange(len(chosen)), [len(found[k]) for k in chosen])
        return quality._gradients(model, np.concatenate([found[k] for k in chosen]), bag, labels[chosen], *weights)

    weighted, repeated = gradients(list(range(6)), counts / counts.mean()), gradients(twice)
    assert all(np.allclose(weighted[n], repeated[n]) for n in weighted)


def test_learning_reads_every_passage(spark, prose, monkeypatch):
    """Documents of 40 passages, bad for one of them, at any place."""
    rows = []
    for k in range(120):
        words = prose(64 * 40, k).split()
        if k % 2:
            place = 64 * (k * 7 % 40)
            words[place : place + 64] = ["***"] * 64
        rows.append((k, " ".join(words), 1 - k % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    held = {}
    monkeypatch.setattr(quality, "fit", lambda bags, labels, settings, weights: held.update(bags=bags, y=labels, w=weights) or 0.5)
    quality.train(docs, docs.select("doc_id", "quality"))
    assert len(held["bags"]) == 120 and {len(b) for b in held["bags"]} == {40}
    assert all((bag[:, quality.N_KINDS + 1] < 0.1).sum() == 1 - y for bag, y in zip(held["bags"], held["y"], strict=True))

    # Fewer rows, not fewer passages, where the budget is small.
    row = 40 * quality.N_FEATURES * 8
    quality.train(docs, docs.select("doc_id", "quality"), Settings(budget=20 * row))
    assert {len(b) for b in held["bags"]} == {40} and 20 <= len(held["bags"]) <= 21
    assert abs(held["y"].sum() - 10) <= 1
    quality.train(docs, docs.select("doc_id", "quality"), Settings(budget=1))
    assert sorted(held["y"]) == [0, 1]


def test_repeated_ids_whatever_the_partitions(spark, prose):
    """Three ids with thousands of texts each, and one row very many times."""
    rows = [(k % 3, f"{'*** ' * (k % 3)}{prose(12, k)}") for k in range(3000)] + [(3, "the same row")] * 1500
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    settings = Settings(sample=400, epochs=2)
    texts = [sorted((bytes(r.raw), r.label, r.weight, r.order) for r in quality.sample_labelled(
        docs.repartition(n), labels, settings, "text", "doc_id", "quality").collect()) for n in (1, 5)]
    assert texts[0] == texts[1] and len(texts[0]) == 800 and len({t[0] for t in texts[0]}) == 800
    scores = [quality.score(docs.limit(50), quality.train(docs.repartition(n), labels, settings)).select("score").collect() for n in (2, 5, 7)]
    assert scores[0] == scores[1] == scores[2]


def plain_score(model, raw, settings):
    """The score of a text, written out passage by passage."""
    words = (raw or b"").split()
    parts = [words[k : k + settings.words] for k in range(0, len(words), settings.words)] or [[]]
    kinds = list(quality._KINDS)
    hidden, strength = [], []
    for part in parts:
        joined = b"".join(part)
        share = [sum(b in members for b in joined) for members in kinds]
        share.append(len(joined) - sum(share))
        x = [math.sqrt(c / max(1, len(joined))) for c in share] + [0.0] * 5
        if part:
            same = sum(a == b for a, b in zip(part, part[1:], strict=False))
            x[-5:] = [1.0, len(set(part)) / len(part), same / len(part), min(len(joined) / len(part), 40) / 10, math.log(1 + len(part)) / 4]
        scaled = [min(8.0, max(-8.0, (v - m) / d)) for v, m, d in zip(x, model.mean, model.spread, strict=True)] + [1.0]
        h = [math.tanh(sum(v * w for v, w in zip(scaled, column, strict=True))) for column in model.E.T]
        t = [math.tanh(sum(a * b for a, b in zip(h, column, strict=True))) for column in model.V.T]
        g = [1 / (1 + math.exp(-sum(a * b for a, b in zip(h, column, strict=True)))) for column in model.U.T]
        hidden.append(h)
        strength.append(sum(a * b * c for a, b, c in zip(t, g, model.w, strict=True)))
    total = sum(math.exp(a) for a in strength)
    pooled = [sum(math.exp(a) * h[k] for a, h in zip(strength, hidden, strict=True)) / total for k in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-sum(p * s for p, s in zip(pooled, model.s, strict=False)) - model.s[-1]))


def test_scores_as_written_out(spark, prose):
    found, labels = bags(40)
    model = quality.fit(found, labels, Settings(epochs=4))
    texts = [None, "", "Ein Wort", "*** " * 200, prose(500, 1), prose(90, 2).upper() + " 12 |#é日本", "a a a b " * 70]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in quality.score(docs, model).collect():
        expected = plain_score(model, r.text.encode() if r.text is not None else None, Settings())
        assert r.score == pytest.approx(expected, abs=2e-6)
