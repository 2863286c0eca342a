"""A linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of ORDERS characters of the lower-cased text, hashed to BUCKETS; each counts as log(1 + its rate
in the text). A feature is scaled by its log-count ratio between toxic and other training documents; logistic regression
with an L2 penalty learns the weights of those seen often enough. The product of weight and ratio is one table, so scoring
a text of any length is a lookup at every character and a sum over the distinct n-grams that count.

Training takes a bounded sample: TRAIN_ROWS labelled rows with TRAIN_CHARS characters in all. Rows with a label other than
0 or 1 don't train. Defined results: null and empty texts score as a text without n-grams; without labels of both kinds
every score is the share of toxic labels (0 where there are none); repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_texts, map_texts
from .training import FOLDS, held_out, sample

ORDERS = (5, 7)
BITS = 22
BUCKETS = 1 << BITS
TRAIN_ROWS = 6000
TRAIN_CHARS = 20_000_000
LEAST_DOCS = 4
LEAST_RATIO = 0.7
#: An n-gram's rate: occurrences by RATE characters, over the text's characters and RATE_ROOM more.
RATE, RATE_ROOM = 4000, 1000
PENALTY = 1.0
STEPS = 120
#: What a toxic training document counts for, against one of a clean document.
TOXIC_WEIGHT = 3.0


def grams(text: str | None) -> np.ndarray:
    """The bucket of every n-gram of a text, in order, repeats included."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    made = []
    for n in ORDERS:
        size = len(points) - n + 1
        if size > 0:
            h = np.full(size, n, np.uint64)
            for j in range(n):
                h *= np.uint64(0x100000001B3)
                h += points[j : j + size]
            h *= np.uint64(0x9E3779B97F4A7C15)
            made.append((h >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(made) if made else np.zeros(0, np.int64)


def values(count: np.ndarray, text: str) -> np.ndarray:
    return np.log1p(RATE * count / (len(text) + RATE_ROOM))


class Model:
    """Buckets that count, the weight of each, and the bias."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float):
        self.buckets, self.weights, self.bias = buckets, weights, bias

    def scorer(self):
        table = np.zeros(BUCKETS, np.float32)
        table[self.buckets] = self.weights

        def score(text: str | None) -> float:
            at = grams(text)
            hit, count = np.unique(at[table[at] != 0], return_counts=True)
            total = self.bias + float((table[hit] * values(count, text or "")).sum(dtype=np.float64))
            return float(1 / (1 + np.exp(-np.clip(total, -60, 60))))

        return score


def train(rows: list[tuple[str, int]]) -> Model:
    y = np.array([label for _, label in rows], np.float64)
    toxic = float(y.sum())
    if not len(y) or toxic in (0.0, float(len(y))):
        share = np.clip(y.mean() if len(y) else 0.0, 1e-26, 1 - 1e-15)
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(share / (1 - share))))
    counts = np.zeros((2, BUCKETS), np.int32)
    for text, label in rows:
        counts[int(label), np.unique(grams(text))] += 1
    seen = counts.sum(0)
    with np.errstate(divide="ignore"):
        ratio = np.log((counts[1] + 1) / (toxic + 2)) - np.log((counts[0] + 1) / (len(y) - toxic + 2))
    use = np.flatnonzero((seen >= LEAST_DOCS) & (np.abs(ratio) >= LEAST_RATIO))
    place = np.full(BUCKETS, -1, np.int32)
    place[use] = np.arange(len(use), dtype=np.int32)
    ratio = ratio[use]
    columns, sizes, parts = [], [], []
    for text, _ in rows:
        own = place[grams(text)]
        own, count = np.unique(own[own >= 0], return_counts=True)
        columns.append(own)
        sizes.append(len(own))
        parts.append(values(count, text).astype(np.float32))
    column, row = np.concatenate(columns), np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    value = np.concatenate(parts)
    weight, bias = np.zeros(len(use)), float(np.log(toxic / (len(y) - toxic)))
    moment, second, b1, b2 = np.zeros(len(use) + 1), np.zeros(len(use) + 1), 0.9, 0.999
    for step in range(1, STEPS + 1):
        score = bias + np.bincount(row, (weight * ratio)[column] * value, len(rows))
        off = (1 / (1 + np.exp(-np.clip(score, -60, 60))) - y) * np.where(y > 0, TOXIC_WEIGHT, 1.0)
        slope = np.append(ratio * np.bincount(column, off[row] * value, len(use)) + PENALTY * weight, off.sum())
        moment, second = b1 * moment + (1 - b1) * slope, b2 * second + (1 - b2) * slope**2
        move = 0.04 * (moment / (1 - b1**step)) / (np.sqrt(second / (1 - b2**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return Model(use, (weight * ratio).astype(np.float32), float(bias))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the documents' labels ``toxic`` outside the held-out fold."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return train(sample(texts, marks, "toxic", TRAIN_ROWS, TRAIN_CHARS))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        one = shared.value.scorer()
        return lambda keys, texts: {"doc_id": keys, "score": [one(t) for t in texts]}

    scored = map_texts(docs, make, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic. Rows that share a doc_id are judged each by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def make():
        one = shared.value.scorer()
        return lambda texts: [one(t) < 0.5 for t in texts]

    return keep_texts(docs, make)


__all__ = ["FOLDS", "Model", "fit", "grams", "keep_clean", "score", "train"]
