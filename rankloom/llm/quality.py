"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of a fixed number of words. Every passage is encoded: shares of kinds of
bytes, word lengths, repeated words and the like go through a learned layer. Gated attention,
``softmax(w . (tanh(V h) * sigmoid(U h)))`` over the passages of a document, weighs the passages, and the
weighted sum of their representations is scored by a logistic unit. Encoder, attention and scorer are
learned together from the labels of documents alone, by Adam on the log loss.

Learning takes a bounded sample of labelled documents: ``Settings.sample`` ids by hash, an equal share of
either label where there are enough, each with all of its passages, so bags in learning and in scoring are
the same. Rows equal in id and text are learned from once; where ids repeat with different texts, there are
at most twice as many texts as ids asked for, chosen by hash of both, so the model depends neither on the
order of the rows nor on their partitions. Should the passages of the sample exceed ``Settings.budget`` bytes, fewer rows are taken, by hash
and whatever their length. The log loss of a sampled row is weighted by how many labelled rows of its label it stands for, so the
scores are those of the labels' true shares, however large the table is.
Scoring reads every passage of every document, a block of passages at a time, and keeps running sums of
the attention, so a text of any length needs the memory of one block beside its words.

Defined results: a null or blank text is one empty passage and gets the score the model gives to that.
A very long text is scored by all its passages. Scores lie between 0 and 1. Without labels of both kinds the score of every document is the share of
label 1, or 1 if there is no label. Repeated rows each get their row; an empty table gives an empty table.
Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rankloom.llm.common import free_name, slices, text_bytes, without
from rankloom.session import materialise

RESULTS = ("score", "predicted")


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample and size of the model."""

    # Labelled ids; with ids that repeat, at most twice as many different texts.
    sample: int = 6000
    # Bytes of encoded passages that are learned from; the row that passes it is the last one.
    budget: int = 64 << 20
    words: int = 64
    hidden: int = 24
    attention: int = 12
    epochs: int = 30
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 5
    # Passages encoded at a time when scoring.
    block: int = 1024


_KINDS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!", b"?", b"|")
_KINDS += (b"#", b"$", b"%", b"&", b"*", b"'\"`", b"()[]{}<>", b"/\\@_=+~^", b":;-", bytes(range(128, 256)))


def _kind_table() -> np.ndarray:
    table = np.full(256, len(_KINDS), np.int64)
    for kind, members in enumerate(_KINDS):
        table[np.frombuffer(members, np.uint8)] = kind
    return table


_KIND = _kind_table()
N_KINDS = len(_KINDS) + 1
N_FEATURES = N_KINDS + 5


def passages(raw: bytes, words: int) -> list[list[bytes]]:
    """Word lists of the passages. One empty if blank."""
    every = raw.split()
    return [every[start : start + words] for start in range(0, len(every), words)] or [[]]


def _encoded(raw: bytes, settings: Settings) -> np.ndarray:
    """Features of all passages of a text, a block at a time."""
    parts = passages(raw, settings.words)
    return np.concatenate([features(parts[k : k + settings.block]) for k in range(0, len(parts), settings.block)])


def features(parts: Sequence[list[bytes]]) -> np.ndarray:
    """One row per passage; no feature depends on the language of the words."""
    joined = [b"".join(words) for words in parts]
    lengths = np.array([len(j) for j in joined], np.int64)
    kinds = _KIND[np.frombuffer(b"".join(joined), np.uint8)]
    place = np.repeat(np.arange(len(parts)), lengths) * N_KINDS + kinds
    counts = np.bincount(place, minlength=len(parts) * N_KINDS).reshape(len(parts), N_KINDS)
    out = np.zeros((len(parts), N_FEATURES))
    out[:, :N_KINDS] = np.sqrt(counts / np.maximum(lengths, 1)[:, None])
    for row, words in enumerate(parts):
        n = len(words)
        if n:
            distinct = len(set(words))
            same = sum(map(bytes.__eq__, words, words[1:]))
            out[row, N_KINDS:] = (1.0, distinct / n, same / n, min(lengths[row] / n, 40) / 10, np.log1p(n) / 4)
    return out


@dataclass
class Model:
    """Weights of encoder (E), gated attention (V, U, w) and scorer (s, with bias last)."""

    mean: np.ndarray
    spread: np.ndarray
    E: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    s: np.ndarray

    names = ("E", "V", "U", "w", "s")

    def encode(self, x: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.tanh(_biased(scaled) @ self.E)

    def attention(self, h: np.ndarray) -> np.ndarray:
        return (np.tanh(h @ self.V) * _sigmoid(h @ self.U)) @ self.w

    def score(self, parts: Sequence[list[bytes]], block: int) -> float:
        """Score of one bag, from running sums of exp(attention) and the weighted representations."""
        top, weight, total = -np.inf, 0.0, np.zeros(self.E.shape[1])
        for start in range(0, len(parts), block):
            h = self.encode(features(parts[start : start + block]))
            a = self.attention(h)
            peak = max(top, float(a.max()))
            scale, e = np.exp(top - peak), np.exp(a - peak)
            top, weight, total = peak, weight * scale + e.sum(), total * scale + e @ h
        return float(_sigmoid(total / weight @ self.s[:-1] + self.s[-1]))

    def score_bags(self, x: np.ndarray, bag: np.ndarray, bags: int) -> np.ndarray:
        """Scores of whole bags whose passages are the rows of ``x``, in order of their bag."""
        h = self.encode(x)
        z, _ = _pool(self.attention(h), h, bag, bags)
        return _sigmoid(z @ self.s[:-1] + self.s[-1])


def _biased(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _pool(a: np.ndarray, h: np.ndarray, bag: np.ndarray, bags: int) -> tuple[np.ndarray, np.ndarray]:
    """Softmax of ``a`` within each bag, and the weighted sums of ``h``. Bags are runs of rows."""
    starts = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]])
    e = np.exp(a - np.maximum.reduceat(a, starts)[bag])
    alpha = e / np.add.reduceat(e, starts)[bag]
    return np.add.reduceat(alpha[:, None] * h, starts), alpha


def fit(
    bags: Sequence[np.ndarray], labels: np.ndarray, settings: Settings = Settings(), weights: np.ndarray | None = None
) -> Model:
    """Learn from bags of passage features, their labels (0 or 1, both present) and weights (all 1 if None)."""
    random = np.random.default_rng(settings.seed)
    weights = np.ones(len(bags)) if weights is None else weights / weights.mean()
    stacked = np.concatenate(bags)
    mean, spread = stacked.mean(axis=0), stacked.std(axis=0) + 1e-3
    wide, deep = settings.hidden, settings.attention
    model = Model(
        mean,
        spread,
        random.normal(0, 0.3, (N_FEATURES + 1, wide)),
        random.normal(0, 0.3, (wide, deep)),
        random.normal(0, 0.3, (wide, deep)),
        random.normal(0, 0.3, deep),
        np.append(random.normal(0, 0.3, wide), 0.0),
    )
    first = {n: np.zeros_like(getattr(model, n)) for n in model.names}
    second = {n: np.zeros_like(getattr(model, n)) for n in model.names}
    step = 0
    for epoch in range(settings.epochs):
        order = random.permutation(len(bags))
        rate = settings.rate * (1 - epoch / settings.epochs)
        for start in range(0, len(order), settings.batch):
            chosen = order[start : start + settings.batch]
            x = np.concatenate([bags[k] for k in chosen])
            bag = np.repeat(np.arange(len(chosen)), [len(bags[k]) for k in chosen])
            step += 1
            for n, g in _gradients(model, x, bag, labels[chosen], weights[chosen]).items():
                values = getattr(model, n)
                g = g + settings.decay * values
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                values -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return model


def _gradients(
    model: Model, x: np.ndarray, bag: np.ndarray, y: np.ndarray, weights: np.ndarray | float = 1.0
) -> dict[str, np.ndarray]:
    """Gradients of the mean over the bags of their weighted log loss."""
    n = len(y)
    inputs = _biased(np.clip((x - model.mean) / model.spread, -8, 8))
    h = np.tanh(inputs @ model.E)
    t, g = np.tanh(h @ model.V), _sigmoid(h @ model.U)
    z, alpha = _pool((t * g) @ model.w, h, bag, n)
    error = (_sigmoid(z @ model.s[:-1] + model.s[-1]) - y) * weights / n
    dz = error[:, None] * model.s[:-1]
    # Softmax: each weight's change acts against the bag's mean.
    da = alpha * (((h - z[bag]) * dz[bag]).sum(axis=1))
    dt, dg = da[:, None] * model.w * g * (1 - t * t), da[:, None] * model.w * t * g * (1 - g)
    dh = alpha[:, None] * dz[bag] + dt @ model.V.T + dg @ model.U.T
    return {
        "E": inputs.T @ (dh * (1 - h * h)),
        "V": h.T @ dt,
        "U": h.T @ dg,
        "w": (t * g).T @ da,
        "s": np.append(z.T @ error, error.sum()),
    }


def sample_labelled(docs: DataFrame, labels: DataFrame, settings: Settings, text: str, key: str, label: str) -> DataFrame:
    """raw, label, weight and order of the distinct rows of about ``settings.sample`` labelled ids at most,
    chosen by hash of their id; of ids that repeat with other texts, twice as many rows at most.

    weight is one over the share of the label's ids that was chosen.
    """
    marks = labels.where(F.col(f"`{label}`").isin(0, 1)).groupBy(F.col(f"`{key}`").alias("key")).agg(
        F.min(F.col(f"`{label}`").cast("int")).alias("label")
    )
    counts = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).toLocalIterator()}
    half = settings.sample // 2
    wanted = {v: max(half, settings.sample - min(half, counts.get(1 - v, 0))) for v in (0, 1)}
    # A few more by hash than wanted; the rest of the labels is never joined.
    steps = 1 << 20
    near = F.pmod(F.xxhash64("key", F.lit(settings.seed)), F.lit(steps))
    quota = {v: max(1, int(steps * min(1.0, 1.1 * wanted[v] / max(1, counts.get(v, 0))))) for v in (0, 1)}
    own = F.when(F.col("label") == 1, quota[1]).otherwise(quota[0])
    some = marks.where(near < own).withColumn("weight", F.lit(float(steps)) / own)
    bodies = docs.select(F.col(f"`{key}`").alias("key"), text_bytes(F.col(f"`{text}`")).alias("raw"))
    joined = bodies.join(F.broadcast(some), "key").withColumns(  # at most 1.1 times the sample
        {"one": F.xxhash64(F.lit(1), "raw"), "two": F.xxhash64(F.lit(2), "raw")}
    )
    # Narrow rows first: which of the different texts. The same for every order of the rows.
    row = ["key", "one", "two"]
    order = F.xxhash64(*row, F.lit(settings.seed)).alias("order")
    chosen = joined.select(*row, order).distinct().orderBy("order", "one", "two").limit(2 * settings.sample)
    chosen = materialise(chosen, "quality-chosen")
    return joined.join(F.broadcast(chosen), row).dropDuplicates(row).select("raw", "label", "weight", "order")


def _within(encoded: DataFrame, settings: Settings) -> Column:
    """Which rows of the encoded sample to learn from: all, or as many of either label as the budget holds.

    Rows are taken by their hash, in the share of their label that has been gone through, so the weights of
    the labels to each other hold for what is taken as well.
    """
    sizes = encoded.select("label", "ordering", "n").collect()
    if sum(r["n"] for r in sizes) * N_FEATURES * 8 <= settings.budget:
        return F.lit(True)
    ranked = []
    for value in (0, 1):
        own = sorted((r["ordering"], r["n"]) for r in sizes if r["label"] == value)
        ranked += [((k + 1) / len(own), value, order, n) for k, (order, n) in enumerate(own)]
    last: dict[int, int] = {}
    used = 0
    for _, value, order, n in sorted(ranked):
        # The first row of either label in any case.
        if value not in last or used < settings.budget:
            last[value] = order
            used += n * N_FEATURES * 8
    return F.lit(False) if not last else F.col("ordering") <= F.when(F.col("label") == 1, last.get(1)).otherwise(last.get(0))


def train(
    docs: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    text: str = "text",
    key: str = "doc_id",
    label: str = "quality",
) -> Model | float:
    """A model, or the share of label 1 where the labels are not of both kinds (1 without labels)."""
    sampled = sample_labelled(docs, labels, settings, text, key, label)
    schema = "label int, weight double, ordering long, n int, values binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = [_encoded(raw, settings) for raw in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label").cast(pa.int32()),
                    batch.column("weight"),
                    batch.column("order"),
                    pa.array([len(r) for r in rows], pa.int32()),
                    pa.array([r.tobytes() for r in rows], pa.binary()),
                ],
                names=["label", "weight", "ordering", "n", "values"],
            )

    encoded = materialise(sampled.mapInArrow(encode, schema), "quality-sample")
    found = encoded.where(_within(encoded, settings)).collect()
    found.sort(key=lambda r: (r["ordering"], r["n"], r["values"]))
    y = np.array([r["label"] for r in found], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return float(y[0]) if len(y) else 1.0
    bags = [np.frombuffer(r["values"]).reshape(r["n"], N_FEATURES) for r in found]
    return fit(bags, y, settings, np.array([r["weight"] for r in found]))


def score(
    docs: DataFrame, model: Model | float, threshold: float = 0.3, settings: Settings = Settings(), text: str = "text"
) -> DataFrame:
    """``docs`` with score and predicted (1 where the score reaches ``threshold``)."""
    rows = without(docs, *RESULTS)
    name = free_name(rows, "score")
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in slices(batches, 128):
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            scores = [held] * len(texts) if isinstance(held, float) else _scores(held, texts, settings)
            # Rounded, so that the same text has the same score in whatever batch it comes.
            column = pa.array(np.round(np.array(scores, dtype=np.float64), 6))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    scored = rows.mapInArrow(run, schema)
    return scored.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.col(name).alias("score"),
        (F.col(name) >= threshold).cast("int").alias("predicted"),
    )


def _scores(model: Model, texts: Sequence[bytes | None], settings: Settings) -> np.ndarray:
    """Scores of some texts: short bags together, a bag of more than one block by itself."""
    scores = np.zeros(len(texts))
    group: list[int] = []
    parts: list[list[bytes]] = []
    bag: list[int] = []

    def flush() -> None:
        if group:
            scores[group] = model.score_bags(features(parts), np.array(bag), len(group))
            group.clear(), parts.clear(), bag.clear()

    for k, raw in enumerate(texts):
        own = passages(raw or b"", settings.words)
        if len(own) > settings.block:
            scores[k] = model.score(own, settings.block)
            continue
        if len(parts) + len(own) > settings.block:
            flush()
        bag += [len(group)] * len(own)
        parts += own
        group.append(k)
    flush()
    return scores
