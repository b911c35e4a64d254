import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.llm import collocations
from rankloom.llm.collocations import Settings

SCHEMA = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, settings):
    """The rows by plain counting."""
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, 5):
                counts[lang].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, found in counts.items():
        often = {p: n for p, n in found.items() if n >= settings.min_count and len(p) > 1}
        rows = []
        for p, a in often.items():
            covered = any(
                len(q) > len(p)
                and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1))
                and 100 * n >= settings.covered * a
                for q, n in often.items()
            )
            if not covered:
                cuts = [(settings.scale * a // (found[p[:k]] + found[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[: settings.keep], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def rows_of(frame):
    assert frame.columns == list(collocations.RESULTS)
    return sorted(tuple(r) for r in frame.collect())


def corpus(seed, n=120):
    source = random.Random(seed)
    vocabulary = ["a", "b", "C", "d", "é", "日本", "of", "the", "new", "york", "x|y", "12"]
    fixed = ["New York city hall", "the a of", "b b b b b", "of the\x1cnew"]
    docs = []
    for k in range(n):
        words = []
        for _ in range(source.randint(0, 30)):
            words.append(source.choice(fixed) if source.random() < 0.3 else source.choice(vocabulary))
            words.append(source.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\r\n", ": "]))
        docs.append((k, "".join(words), source.choice(["en", "en", "en", "fr", None, "und"])))
    return docs + [(None, None, "en"), (1, "", None), (2, " .,\n", "de"), (3, "lone", "it")] + docs[:5]


@pytest.mark.parametrize(
    ("settings", "budget"),
    [(Settings(min_count=4), 1 << 20), (Settings(min_count=2, keep=7), 5), (Settings(min_count=12, covered=50), 1), (Settings(min_count=1, keep=10_000), 40)],
)
def test_as_by_counting(spark, monkeypatch, settings, budget):
    docs = corpus(settings.min_count)
    monkeypatch.setattr(collocations, "BUDGET", budget)
    frame = spark.createDataFrame(docs, SCHEMA).repartition(5)
    assert rows_of(collocations.mine(frame, settings)) == brute(docs, settings)


def test_few_groups_and_small_filters(spark, monkeypatch):
    docs = corpus(9)
    monkeypatch.setattr(collocations, "MAX_GROUPS", 3)
    monkeypatch.setattr(collocations, "BUDGET", 1)
    monkeypatch.setattr(collocations, "FILTER_BITS", 6)  # lets nearly all pass
    monkeypatch.setattr(collocations, "SLICES", 3)
    monkeypatch.setattr(collocations, "SHARE_ROWS", 5)
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
    assert rows_of(collocations.mine(frame, Settings(3, keep=20))) == brute(docs, Settings(3, keep=20))


def test_words_that_share_a_hash_start_again(spark, monkeypatch):
    seeds, plain = [], collocations._word_rows

    def shared_at_first(texts, seed):
        seeds.append(seed)
        rows = plain(texts, seed)
        return rows.withColumn("high", F.col("low") + 1) if seed == 1 else rows

    monkeypatch.setattr(collocations, "_word_rows", shared_at_first)
    docs = corpus(5)
    found = rows_of(collocations.mine(spark.createDataFrame(docs, SCHEMA), Settings(5)))
    assert found == brute(docs, Settings(5)) and seeds == [1, 3]


def test_second_hash_tells_words_apart(spark, monkeypatch):
    """With a first hash that is the same for all words, the range of the second one shows it."""
    monkeypatch.setattr(collocations.Block, "hashes", lambda self, seed: np.arange(len(self.starts)) * (seed > 1) + seed)
    block = collocations._block([b"two words"], ["en"])
    assert block.hashes(1).tolist() == [1, 1] and block.hashes(2).tolist() == [2, 3]
    found = []
    monkeypatch.setattr(collocations, "_blocks", lambda batches: iter([block]))

    class Frame:
        mapInArrow = staticmethod(lambda run, schema: found.extend(run(iter([]))))

    collocations._word_rows(Frame(), 1)
    rows = pa.Table.from_batches(found).to_pylist()
    assert [(r["n"], r["low"], r["high"]) for r in rows if r["k1"] is not None] == [(2, 2, 3)]


def test_sums_hand_on_what_they_hold(monkeypatch):
    monkeypatch.setattr(collocations, "HELD_ROWS", 8)
    source = np.random.default_rng(1)
    sums, total, expected = collocations.Sums(2), Counter(), Counter()
    for _ in range(200):
        left, right = source.integers(0, 9, (2, 5))
        expected.update(zip(left.tolist(), right.tolist(), strict=True))
        done = sums.add([left, right])
        for a, b, n in done.T.tolist() if done is not None else ():
            total[a, b] += n
    for a, b, n in sums.rest().T.tolist():
        total[a, b] += n
    assert total == expected and not sums.rest().size


def test_groups_are_within_the_budget(spark):
    source = np.random.default_rng(2)
    rows = [(k, 0, int(source.zipf(1.5) % 5000) + 1) for k in range(3000)] + [(99_999, 0, 40_000)]
    prefixes = collocations._with_order(spark.createDataFrame(rows, "k1 long, k2 long, n long"))
    groups = collocations.group_prefixes(prefixes.cache(), 2000, 1 << 20)
    order = np.array([r.order for r in prefixes.collect()])
    sizes = np.array([r.n for r in prefixes.collect()])
    group, parts = groups.of(order)
    load = Counter()
    for g, n, p in zip(group, sizes, parts, strict=True):
        load[g] += n if p == 1 else 0
        assert p == (max(1, -(-n // 2000)))
    assert max(load.values()) <= 2 * 2000 and len(load) <= sizes.sum() // 2000 + 2


def test_texts_cut_at_piece_ends_and_very_long_ones(spark, monkeypatch):
    assert b"|".join(collocations._parts(b"aa bb. cc dd, ee", 3)) == b"aa bb| cc dd, ee".replace(b", ", b"| ")
    docs = [(1, "red green blue. " * 150_000, "en"), (2, "x" * 3_000_000, "en"), (3, "long words " * 400, "fr")]
    found = rows_of(collocations.mine(spark.createDataFrame(docs, SCHEMA)))
    assert found == brute(docs, Settings())


def test_other_names_and_empty_tables(spark):
    docs = spark.createDataFrame([("a b " * 40, "en", 1, 2, "z")], "body string, tongue string, k1 int, N int, lang string")
    found = rows_of(collocations.mine(docs, text="body", lang="tongue"))
    assert found == brute([(1, "a b " * 40, "en")], Settings())
    assert collocations.mine(docs.limit(0), text="body", lang="tongue").collect() == []
