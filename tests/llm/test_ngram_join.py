import collections
import random
import re

import numpy as np
import pytest

from rankloom.llm import ngram_join
from rankloom.llm.ngram_join import Settings
from rankloom.session import materialise

SCHEMA = "doc_id long, text string"


def sets_of(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    n = min(5, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()


def brute(rows):
    sets = {k: sets_of(t) for k, t in rows}
    ids, links, parent = sorted(sets), collections.Counter(), {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            union = len(sets[a] | sets[b])
            if union and len(sets[a] & sets[b]) / union >= 0.8:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (links[k], root(k)) for k in ids}


def corpus(prose, n, seed):
    """Texts with copies that change from no word to every tenth."""
    source, rows, base = random.Random(seed), [], []
    for k in range(n):
        if k % 4 == 0:
            base = prose(source.randint(6, 120), seed * 1000 + k).split()
        words = [w if source.random() > (k % 4) * 0.012 else f"new{k}" for w in base]
        rows.append((k, " ".join(words) + (" ." if k % 8 == 5 else "")))
    return rows


@pytest.mark.parametrize("settings", [Settings(), Settings(block_weight=2000)])
def test_against_brute_force(spark, prose, settings):
    rows = corpus(prose, 400, 3)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    found = {r.doc_id: (r.n_links, r.component_id) for r in ngram_join.join(frame, settings).collect()}
    assert found == brute(rows)


def test_large_group_of_near_copies(spark, prose):
    """Near copies are a third of all rows; no link between different texts may be lost."""
    base = prose(100, 1).split()
    rows = []
    for k in range(450):
        words = list(base) if k % 3 == 0 else prose(60, 50 + k).split()
        words[k % len(words)] = f"w{k}"
        rows.append((k, " ".join(words)))
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id: (r.n_links, r.component_id) for r in ngram_join.join(frame, Settings(block_weight=8000)).collect()}
    assert found == brute(rows)


def test_posterior_keeps_pairs_at_the_threshold():
    settings = Settings()
    source = np.random.default_rng(1)
    looks = ngram_join.least_agreements(settings)
    assert [n for n, _ in looks] == [32, 64, 96, 128]
    agree = source.random((200_000, settings.hashes)) < settings.threshold
    kept = np.ones(len(agree), bool)
    for n, need in looks:
        kept &= agree[:, :n].sum(axis=1) >= need
    assert kept.mean() > 0.9999
    unlike = source.random((20_000, settings.hashes)) < 0.3
    assert (unlike[:, :32].sum(axis=1) >= looks[0][1]).mean() < 0.35
    assert (unlike.sum(axis=1) >= looks[-1][1]).mean() == 0


def test_min_hashes_estimate_similarity():
    settings = Settings()
    factors, terms = ngram_join._hash_family(settings)
    source = np.random.default_rng(2)
    grams = source.integers(0, 2**63, 9000, dtype=np.uint64)
    a, b = np.unique(grams[:8500]), np.unique(grams[500:])
    same = (ngram_join.min_hashes(a, factors, terms) == ngram_join.min_hashes(b, factors, terms)).mean()
    assert abs(same - 8000 / 9000) < 0.1


def test_odd_rows_and_keeping_one(spark, prose):
    text = prose(40, 9)
    rows = [
        (5, text, 1), (3, text.upper() + "!", 1), (5, text, 1), (7, None, 1), (8, None, 1), (9, "", 1), (10, "!!", 1),
        (11, "one two", 1), (12, "One, two.", 1), (None, text + " end", 1), (13, prose(20_000, 4), 1), (None, None, 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_Links int")
    joined = ngram_join.join(docs)
    found = collections.defaultdict(list)
    for r in joined.collect():
        found[r.doc_id].append((r.n_links, r.class_id, r.component_id, r.kept))
    assert found[5] == [(3, 3, 3, False)] * 2 and found[3] == [(3, 3, 3, True)]
    assert sorted(found[None], key=str) == sorted([(3, None, 3, False), (0, None, None, True)], key=str)
    assert all(found[k] == [(0, k, k, True)] for k in (7, 8, 9, 10, 13))
    assert found[11] == [(1, 11, 11, True)] and found[12] == [(1, 11, 11, False)]
    kept = ngram_join.keep_one(docs, materialise(joined, "joined"))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 7, 8, 9, 10, 11, 13]
    assert ngram_join.join(docs.limit(0)).collect() == []
    assert ngram_join.keep_one(docs.limit(0), ngram_join.join(docs.limit(0))).collect() == []
