"""The two classifiers against loops that say the same without arrays, and over repeated rows and very long texts."""

import math
import random

import numpy as np

from millrace.llm import langid, toxicity

TEXTS = ["vileword and more", "Ab é cd", "x", "", "nothing " * 40, "VILEWORD " * 9]


def network():
    made = langid.Network(["a", "b", "c"], seed=3)
    rng = np.random.default_rng(4)
    made.shift = rng.normal(0, 0.3, made.shift.shape).astype(np.float32)
    made.bias = rng.normal(0, 0.3, made.bias.shape).astype(np.float32)
    return made


def one_window(net, raw):
    """Class probabilities of the bytes of one window."""
    seen = [net.embed[b] for b in raw] + [net.embed[langid.PAD]] * (langid.WINDOW - len(raw) + max(langid.WIDTHS))
    pooled = []
    for k, width in enumerate(langid.WIDTHS):
        for f in range(langid.FILTERS):
            column = net.filters[: width * langid.EMBED, k * langid.FILTERS + f]
            sums = [float(np.dot(np.concatenate(seen[i : i + width]), column)) for i in range(langid.WINDOW)]
            pooled.append(max(0.0, max(sums) + float(net.shift[k * langid.FILTERS + f])))
    z = [sum(p * float(w) for p, w in zip(pooled, net.out[:, c], strict=True)) + float(net.bias[c]) for c in range(len(net.langs))]
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_language_as_by_loops(monkeypatch):
    monkeypatch.setattr(langid, "WINDOW", 24)
    net = network()
    texts = ["Ab é cd", "x" * 60 + "yz", "One two three four five six"]
    for text, (lang, score) in zip(texts, net.predict(texts), strict=True):
        raw = text.lower().encode()
        parts = [raw[i : i + 24] for i in range(0, len(raw), 24)]
        made = [one_window(net, p) for p in parts]
        mean = [sum(m[c] * len(p) for m, p in zip(made, parts, strict=True)) / len(raw) for c in range(3)]
        assert lang == net.langs[max(range(3), key=lambda c: mean[c])] and abs(score - max(mean)) < 1e-4


def bucket(gram):
    h = len(gram)
    for c in gram:
        h = (h * 0x100000001B3 + ord(c)) % 2**64
    return (h * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BITS)


def test_toxicity_as_by_loops():
    rng = random.Random(5)
    rows = [(" ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(20)) + " vileword" * (k % 3 == 0), int(k % 3 == 0)) for k in range(90)]
    model = toxicity.train(rows)
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    assert weight
    score = model.scorer()
    for text in [*TEXTS, rows[0][0], rows[1][0]]:
        count = {}
        wide = f" {text.lower()} " if text else ""
        for n in toxicity.ORDERS:
            for i in range(len(wide) - n + 1):
                b = bucket(wide[i : i + n])
                count[b] = count.get(b, 0) + 1
        rate = {b: math.log1p(toxicity.RATE * c / (len(text) + toxicity.RATE_ROOM)) for b, c in count.items()}
        total = model.bias + sum(weight.get(b, 0.0) * x for b, x in rate.items())
        assert abs(score(text) - 1 / (1 + math.exp(-total))) < 1e-6


def test_repeated_rows_and_very_long_texts(spark):
    long = "one two three four " * 60_000
    rows = [(k, f"{'one two' if k % 2 else 'ten six'} {'vileword' * (k % 5 == 0)} {k}", "ab"[k % 2]) for k in range(200)]
    docs = spark.createDataFrame([*rows, *rows[:20], (7, "of another text", "a"), (None, "no id", None), (900, long, "b"), (900, long, "b")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(200)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    named = langid.predict(docs, langid.fit(docs)).collect()
    assert len(scored) == len(named) == 224
    for got in (scored, named):
        assert len({tuple(r) for r in got if r.doc_id == 900}) == 1
        assert all(len({tuple(r) for r in got if r.doc_id == k}) == 1 for k in range(20) if k != 7)
