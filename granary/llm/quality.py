"""Quality classification by positive-unlabelled learning with a non-negative unbiased risk."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, arrow_map, text_of, train_rows

#: Rows that the classifier is fitted on at most: trusted positives, unlabelled texts.
POSITIVES, UNLABELLED = 6000, 12_000
FOLDS, HELD_OUT, CUT = 5, 0, 0.3

_CLASS = np.full(256, 5)
_CLASS[np.r_[48:58]] = 0
_CLASS[np.r_[65:91]] = 1
_CLASS[np.r_[97:123, 128:256]] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 4


def features(text: str) -> list[float]:
    """Shape of a text, whole; most values lie in 0 to 1. An empty text gives zeros but for its own mark."""
    raw = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, int)
    digit, upper, lower, space, marks, odd = np.bincount(_CLASS, weights=count, minlength=6).tolist()
    words = text.split()
    n, size = len(words), max(1, len(raw))
    number = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    ends = sum(count[[ord(c) for c in ".!?"]])
    distinct = len(number)
    top = max(number.values(), default=0)
    length = sum(map(len, words)) / max(1, n)
    expected = n**0.75 if n else 1.0
    return [
        float(n == 0), math.log1p(n) / 10, digit / size, upper / max(1.0, upper + lower), upper / size, space / size, marks / size, odd / size,
        count[33] / max(1, n), count[124] / max(1, n), sum(count[[35, 36, 37, 38, 42, 64, 94, 126]]) / max(1, n), distinct / max(1, n), min(2.0, distinct / expected), top / max(1, n),
        pairs / max(1, n - 1), 1 - len(set(lines)) / max(1, len(lines)), len(lines) / max(1, n), min(3.0, length / 10), min(2.0, ends / max(1, n) * 5), max(map(len, words), default=0) / 100 if n else 0.0,
        float(n < 5), float(n < 20), sum(c for c in number.values() if c > max(3, n // 100)) / max(1, n),
    ]


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]
    scale: tuple[float, float]
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        h = np.clip((x - self.mean) / self.spread, -8, 8)
        for k, (w, b) in enumerate(self.layers):
            h = h @ w + b
            if k < len(self.layers) - 1:
                h = np.tanh(h)
        return h[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + b, -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled, from scores of a classifier of the one against the other: the least
    ratio of the two shares of scores above a threshold, with the margin of its estimate (best-bin estimation)."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    best, out = math.inf, 0.5
    margin = sum(math.sqrt(math.log(4 / delta) / (2 * n)) for n in (len(positive), len(unlabelled)))
    for t in np.quantile(positive, np.linspace(0, 0.95, 96)):
        p, u = (positive >= t).mean(), (unlabelled >= t).mean()
        if p > 0.01 and (bound := (u + margin) / p) < best:
            best, out = bound, u / p
    return float(min(0.98, max(0.02, out)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, hidden: int = 16, steps: int = 600, rate: float = 0.01, seed: int = 11) -> Model:
    """A small network that minimises the non-negative PU risk of the sigmoid loss l(z) = 1 / (1 + exp(z)):

        prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])

    Where the second term falls below zero, its gradient is turned round instead, so that the network can't call unlabelled
    texts negative beyond what the prior leaves. prior None: positives against unlabelled, that is a prior of 0 for them.
    """
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, spread = both.mean(0), both.std(0) + 1e-3
    model = Model(mean, spread, [(rng.normal(0, 1 / math.sqrt(both.shape[1]), (both.shape[1], hidden)), np.zeros(hidden)), (rng.normal(0, 0.3, (hidden, 1)), np.zeros(1))], (1.0, 0.0), prior or 0.5)
    p, u = (np.clip((x - mean) / spread, -8, 8) for x in (positive, unlabelled))
    state = [[np.zeros_like(v), np.zeros_like(v)] for layer in model.layers for v in layer]
    for step in range(1, steps + 1):
        (w1, b1), (w2, b2) = model.layers
        x = np.concatenate([p[rng.integers(0, len(p), 1024)], u[rng.integers(0, len(u), 2048)]])
        h = np.tanh(x @ w1 + b1)
        g = np.clip((h @ w2 + b2)[:, 0], -30, 30)
        s = 1 / (1 + np.exp(-g))  # l(-g); l(g) = 1 - s
        slope = s * (1 - s)
        grad = np.zeros_like(g)
        if prior is None:
            grad[:1024] = -slope[:1024] / 1024
            grad[1024:] = slope[1024:] / 2048
        else:
            rest = s[1024:].mean() - prior * s[:1024].mean()
            sign = 1.0 if rest >= 0 else -1.0
            grad[1024:] = sign * slope[1024:] / 2048
            grad[:1024] = -sign * prior * slope[:1024] / 1024
            if rest >= 0:
                grad[:1024] -= prior * slope[:1024] / 1024
        dh = np.outer(grad, w2[:, 0]) * (1 - h**2)
        grads = [x.T @ dh + 1e-5 * w1, dh.sum(0), h.T @ grad[:, None] + 1e-5 * w2, grad.sum(keepdims=True)]
        values = [w1, b1, w2, b2]
        for v, d, m in zip(values, grads, state):
            m[0] = 0.9 * m[0] + 0.1 * d
            m[1] = 0.999 * m[1] + 0.001 * d**2
            v -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return model


def calibrated(positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float = 1e-3, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic curve through raw scores, from positives, unlabelled texts and the prior alone: the least

        E_u[log(1 + exp(f))] - prior * E_p[f],  f = slope * z + offset

    is the logistic risk of the unlabelled texts, if a share `prior` of them is like the positives, and is convex in both.
    Where it is least, the mean score of the unlabelled is the prior."""
    centre, spread = unlabelled.mean(), unlabelled.std() + 1e-9
    u, p = (np.stack([(z - centre) / spread, np.ones_like(z)], 1) for z in (unlabelled, positive))
    w = np.array([1.0, math.log(prior / (1 - prior))])
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        gradient = u.T @ s / len(u) - prior * p.mean(0) + ridge * w
        step = np.linalg.solve((u * (s * (1 - s))[:, None]).T @ u / len(u) + ridge * np.eye(2), gradient)
        w = w - step * min(1.0, 1 / max(1e-9, np.abs(step).max()))
    return (float(w[0] / spread), float(w[1] - w[0] * centre / spread)) if w[0] > 0 else (1.0, 0.0)


def _sample(docs: DataFrame, ids: DataFrame, limit: int, role: str) -> DataFrame:
    """The texts of at most `limit` of the ids, by their hash."""
    # At most `limit` ids, so they may go to every task.
    few = F.broadcast(ids.orderBy(F.xxhash64("label_id", F.lit(role)), "label_id").limit(limit))
    return docs.join(few, docs["doc_id"] == F.col("label_id")).select(F.lit(role).alias("role"), "doc_id", text_of().alias("text"))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Trains on at most `positives` texts labelled 1 and `unlabelled` texts of which no label is used; the class prior, and
    with it the final scale, come from the same two. Labels of rows that are held out, and labels 0, aren't used. Samples
    are chosen by a hash of doc_id; of several rows with one doc_id one counts. Without positives, every text scores 0.5."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    known = known.filter(train_rows(F.col("doc_id"), FOLDS, HELD_OUT)).filter("label = 1").select(F.col("doc_id").alias("label_id"))
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    every = docs.select(F.col("doc_id").alias("label_id")).distinct()
    parts = _sample(docs, known, positives, "positive").unionByName(_sample(docs, every, unlabelled, "unlabelled"))

    def rows(c: dict) -> Iterator[tuple]:
        return [(r, d, features(t)) for r, d, t in zip(c["role"], c["doc_id"], c["text"])]

    found = arrow_map(parts.withColumn("doc_id", F.col("doc_id").cast("long")), rows, "role string, doc_id long, x array<double>").groupBy("role", "doc_id").agg(F.min("x").alias("x")).toPandas()
    found["key"] = found.x.map(tuple)
    found = found.sort_values(["role", "key"])  # the same model however rows arrive
    of = lambda role: np.array(found.x[found.role == role].tolist()).reshape(-1, len(features("")))
    positive, web = of("positive"), of("unlabelled")
    if not len(positive) or not len(web):
        return Model(np.zeros(len(features(""))), np.ones(len(features(""))), [(np.zeros((len(features("")), 1)), np.zeros(1))], (1.0, 0.0), 0.5)
    rng = np.random.default_rng(5)
    positive, web = positive[rng.permutation(len(positive))], web[rng.permutation(len(web))]
    half = max(1, len(positive) // 2)
    first = train(positive[:half], web[: max(1, len(web) // 2)], None)
    prior = class_prior(first.raw(positive[half:] if len(positive) > half else positive), first.raw(web[len(web) // 2 :]))
    model = train(positive, web, prior)
    model.scale = calibrated(model.raw(positive), model.raw(web), prior)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; null text counts as empty. A null doc_id isn't held out. Repeated rows
    are each scored, whole texts however long, and other columns, whatever their names, are left; an empty table gives an
    empty result."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def rows(c: dict) -> Iterator[tuple]:
        s = spread.value.score(np.array([features(t) for t in c["text"]]))
        return [(d, bool(h), float(v), int(v >= CUT)) for d, h, v in zip(c["doc_id"], c["held"], s)]

    held = F.coalesce(~train_rows(F.col("doc_id"), FOLDS, HELD_OUT), F.lit(False))
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), held.alias("held")), rows, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of docs, all columns, whose text scores `cut` or more."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column(part.schema.names.index("text")).to_pylist()
                yield part.filter(pa.array(spread.value.score(np.array([features(t or "") for t in texts])) >= cut))

    return docs.mapInArrow(run, docs.schema)
