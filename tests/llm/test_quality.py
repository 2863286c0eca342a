import random
import re
from collections import Counter

import numpy as np

from millrace.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many, seen, dup = Counter(windows), set(), 0
    inside = {j for i, w in enumerate(windows) if many[w] > 1 for j in (i, i + 1, i + 2)}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 50 or 100 * len(inside) > 50 * n
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed)


def texts(seed):
    rng = random.Random(seed)
    made = [None, "", " \n\n", "a a a a", "x\x1cy\x85z é😀 #|<>\n" * 3, "word " * 3000]
    for _ in range(80):
        words = [rng.choice(["the", "of", "and", "#a", "é", "longer"]) for _ in range(rng.randint(0, 120))]
        made.append("".join(w + rng.choice(["\n", " ", "  ", "\t"]) for w in words))
    return made + made[:8]


def test_base_measures(spark):
    rows = list(enumerate(texts(8)))
    docs = spark.createDataFrame([(k, t, "en", 1) for k, t in rows], "doc_id long, text string, lang string, n_words int")
    got = {r.doc_id: r for r in quality.assess(docs).collect()}
    for k, t in rows:
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t)
        assert not (r.base_failed and r.kept)
    assert quality.assess(docs.limit(0)).count() == 0


def test_many_distinct_words_use_pairs():
    codes = np.arange(1 << 21)
    codes[-3:] = codes[:3]
    assert quality.repeat_words(codes) == 6


def test_distance():
    p, q = np.array([1.0, 0]), np.array([0, 2.0])
    assert quality.js_distance(p, q) == 1 and quality.js_distance(p, 3 * p) == 0
    assert quality.js_distance(np.zeros(2), p) == 1


def test_odd_documents_are_not_kept(spark):
    rng = random.Random(9)
    usual = ["the", "of", "and", "to", *[f"w{chr(97 + i)}{chr(98 + j)}" for i in range(20) for j in range(20)]]
    weight = [60, 40, 30, 20] + [1] * 400
    rows = [(k, " ".join(rng.choices(usual, weight, k=150)), "en") for k in range(60)]
    rows += [(100, " ".join(f"{rng.choice(usual)}$$$" for _ in range(150)), "en"), (101, "| zq | yx " * 3 + " | ".join(f"q{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)), "en")]
    got = {r.doc_id: r.kept for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[100] and not got[101] and sum(got[k] for k in range(60)) >= 58


def test_every_language_makes_a_reference(spark):
    rng = random.Random(10)
    rows = []
    for k in range(70):
        usual = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(6)]
        for i in range(3 if k else 2):  # the first language has fewest words
            rows.append((3 * k + i, " ".join(rng.choices(usual, range(30, 0, -1), k=100)), f"lang{k:02}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(quality.references(docs)) == 70
    got = {r.doc_id: r for r in quality.assess(docs).collect()}
    assert all(r.kept and r.word_distance < 0.46 for r in got.values())
