"""Language identification by a byte convolutional network, trained and applied in numpy.

Lower-cased UTF-8 bytes go in windows of WINDOW; a byte embedding, filters of several WIDTHS, max pooling over the window
and a softmax give a distribution for each window. A document's distribution is the mean over all its windows, weighted by
their bytes.

Training takes WINDOWS_OF_ONE windows of each row of a bounded sample: TRAIN_ROWS rows with TRAIN_CHARS characters in all.
Defined results: a null
text and one without a letter are ``und`` with score 0, as is everything where no row has a lang; one known lang is
predicted for all; ties go to the lang that sorts first; repeated rows are predicted alike.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_texts, map_texts
from .training import held_out, sample

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
EMBED, FILTERS = 8, 16
PAD = 256
TRAIN_ROWS = 4000
TRAIN_CHARS = 16_000_000
WINDOWS_OF_ONE = 3
STEPS, BATCH = 700, 48
#: Windows that go through the network at once.
BLOCK = 64
#: Characters that may be letters; what the category decides is tested on them alone.
WORD = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of Unicode's letter categories (not one like ½, ² or Ⅷ, which are numbers)."""
    return any(unicodedata.category(m[0])[0] == "L" for m in WORD.finditer(text or ""))


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a text as rows of byte numbers, padded, and how many bytes each has."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-len(raw) // WINDOW))
    out = np.full(n * WINDOW, PAD, np.int16)
    out[: len(raw)] = raw
    sizes = np.full(n, WINDOW)
    sizes[-1] = len(raw) - (n - 1) * WINDOW
    return out.reshape(n, WINDOW), sizes


class Network:
    def __init__(self, langs: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.embed = rng.normal(0, 0.5, (PAD + 1, EMBED)).astype(np.float32)
        self.embed[PAD] = 0
        wide = max(WIDTHS)
        self.filters = np.zeros((wide * EMBED, len(WIDTHS) * FILTERS), np.float32)
        self.mask = np.zeros_like(self.filters)  # a narrow filter sees the first bytes of the widest one's only
        for k, w in enumerate(WIDTHS):
            part = np.s_[: w * EMBED, k * FILTERS : (k + 1) * FILTERS]
            self.filters[part] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS))
            self.mask[part] = 1
        self.shift = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def _pooled(self, rows: np.ndarray, where: bool = False):
        """Max-pooled filter outputs, and with ``where`` the place of each maximum."""
        wide = max(WIDTHS)
        padded = np.concatenate([rows, np.full((len(rows), wide - 1), PAD, np.int16)], axis=1)
        seen = self.embed[padded].reshape(len(rows), -1)
        step = seen.strides[1] * EMBED
        view = np.lib.stride_tricks.as_strided(seen, (len(rows), WINDOW, wide * EMBED), (seen.strides[0], step, seen.strides[1]))
        made = (view.reshape(-1, wide * EMBED) @ self.filters).reshape(len(rows), WINDOW, -1)
        if not where:
            return np.maximum(made.max(1) + self.shift, 0)
        at = made.argmax(1)
        top = np.take_along_axis(made, at[:, None], 1)[:, 0] + self.shift
        return np.maximum(top, 0), at, view

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(rows), BLOCK):
            z = self._pooled(rows[i : i + BLOCK]) @ self.out + self.bias
            e = np.exp(z - z.max(1, keepdims=True))
            parts.append(e / e.sum(1, keepdims=True))
        return np.concatenate(parts)

    def train(self, rows: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        names = ("embed", "filters", "shift", "out", "bias")
        moment = {n: np.zeros_like(getattr(self, n)) for n in names}
        second = {n: np.zeros_like(getattr(self, n)) for n in names}
        wide = max(WIDTHS)
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(rows), BATCH)
            x = rows[pick]
            pooled, at, view = self._pooled(x, where=True)
            z = pooled @ self.out + self.bias
            e = np.exp(z - z.max(1, keepdims=True))
            off = e / e.sum(1, keepdims=True)
            off[np.arange(BATCH), labels[pick]] -= 1
            off /= BATCH
            back = (off @ self.out.T) * (pooled > 0)
            seen = view[np.arange(BATCH)[:, None], at]  # what each filter saw at its maximum
            slopes = {
                "out": pooled.T @ off,
                "bias": off.sum(0),
                "shift": back.sum(0),
                "filters": np.einsum("bfe,bf->ef", seen, back) * self.mask,
            }
            padded = np.concatenate([x, np.full((BATCH, wide - 1), PAD, np.int16)], axis=1)
            drawn = (back[:, :, None] * self.filters.T[None]).reshape(-1, EMBED)
            bytes_at = padded[np.arange(BATCH)[:, None, None], at[:, :, None] + np.arange(wide)].ravel()
            slopes["embed"] = np.zeros_like(self.embed)
            np.add.at(slopes["embed"], bytes_at, drawn)
            slopes["embed"][PAD] = 0
            rate = 0.01 if step < steps * 2 // 3 else 0.002
            for n in names:
                moment[n] = 0.9 * moment[n] + 0.1 * slopes[n]
                second[n] = 0.999 * second[n] + 0.001 * slopes[n] ** 2
                move = (moment[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-7)
                setattr(self, n, (getattr(self, n) - rate * move).astype(np.float32))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        held, held_rows = [], 0

        def flush() -> None:
            nonlocal held, held_rows
            if held:
                p = self.probabilities(np.concatenate([x for _, x, _ in held]))
                a = 0
                for i, x, sizes in held:
                    mean = np.average(p[a : a + len(x)], axis=0, weights=sizes)
                    a += len(x)
                    best = int(mean.argmax())
                    out[i] = (self.langs[best], float(min(1.0, max(0.0, mean[best]))))
            held, held_rows = [], 0

        for i, text in enumerate(texts):
            if self.langs and has_letter(text):
                held.append((i, *windows(text)))
                held_rows += len(held[-1][1])
                if held_rows >= 4 * BLOCK:
                    flush()
        flush()
        return out


def fit(docs: DataFrame) -> Network:
    """A network from the documents' lang outside the held-out fold."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = [(t, lang) for t, lang in sample(texts, None, "lang", TRAIN_ROWS, TRAIN_CHARS) if has_letter(t)]
    langs = sorted({lang for _, lang in rows})
    net = Network(langs)
    if len(langs) > 1:
        rng = np.random.default_rng(3)
        made, labels = [], []
        for text, lang in rows:
            own, _ = windows(text)
            pick = rng.permutation(len(own))[:WINDOWS_OF_ONE]
            made.append(own[pick])
            labels += [langs.index(lang)] * len(pick)
            short = own[pick[:1]].copy()  # short texts are padded: learn from some, too
            short[0, rng.integers(8, 64) :] = PAD
            made.append(short)
            labels.append(langs.index(lang))
        net.train(np.concatenate(made), np.array(labels))
    return net


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        def call(keys: list, texts: list) -> dict:
            found = shared.value.predict(texts)
            return {"doc_id": keys, "lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

        return call

    made = map_texts(docs, make, "doc_id long, lang_pred string, score double")
    return made.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: Documents below this score are rejected.
LEAST_SCORE = 0.5


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is told with LEAST_SCORE at least."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def make():
        return lambda texts: [x != UNKNOWN and s >= LEAST_SCORE for x, s in shared.value.predict(texts)]

    return keep_texts(docs, make)
