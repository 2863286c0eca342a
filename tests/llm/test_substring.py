import hashlib
import random
import re
from collections import Counter

import pytest

from millrace.llm import substring


def brute(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (k, _), words in zip(rows, split):
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((k, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def rows(seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    made = [None, "", " \n", "x " * 50, "a\x1cb\x85c  d"]
    for _ in range(60):
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))]
        a = rng.randint(0, 30)
        words[len(words) // 2 : len(words) // 2] = passage[a : a + rng.randint(0, 30)]
        made.append(rng.choice(" \n\t").join(words))
    made += made[:12]
    return [(k if k % 9 else 0, t) for k, t in enumerate(made)]


@pytest.mark.parametrize("window,gram", [(8, 3), (12, 12), (35, 16)])
def test_digests_match_brute_force(spark, window, gram):
    table = rows(window)
    docs = spark.createDataFrame([(k, t, "x") for k, t in table], "doc_id long, text string, mark string")
    got = sorted(tuple(r) for r in substring.digests(docs, window, gram).collect())
    assert got == brute(table, window)


def test_texts_lose_their_repeats_and_keep_their_columns(spark):
    same = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"a {same} b", "s"), (2, same, "t"), (None, "c\n d", "u")], "doc_id long, text string, source string")
    got = {r.source: r.text for r in substring.without_repeats(docs).collect()}
    assert got == {"s": "a b", "t": "", "u": "c\n d"}
    assert substring.without_repeats(docs).columns == docs.columns
    assert substring.digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("batches,most_runs,order", [(1, 1, 1), (4, 2, 1), (3, 8, -1)])
def test_batches_in_any_number_and_order_give_the_whole(spark, batches, most_runs, order, tmp_path):
    table = rows(8)
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(2)
    path = f"file://{tmp_path}/index"
    taken = docs.limit(0)
    for k in list(range(batches))[::order]:
        index = substring.PassageIndex(spark, path, most_runs, 8, 3)  # opened again for every batch
        batch = docs.where(f"doc_id % {batches} = {k}")
        taken = taken.unionByName(batch)
        index.add(batch, taken)
        assert len(index.files["runs"]) <= most_runs
        hashes = [r.hash for r in spark.read.parquet(index.files["runs"][-1]).coalesce(1).collect()]
        assert hashes and len(index.files["sketches"]) <= batches
    index = substring.PassageIndex(spark, path, most_runs, 8, 3)
    got = sorted(tuple(r) for r in substring.digests(docs, 8, 3, index).collect())
    assert got == brute(table, 8)


def test_a_very_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    long = " ".join(f"w{i}" for i in range(300_000))
    table = [(1, f"{long} {passage}"), (2, f"x {passage} y"), (3, long[: len(long) // 2])]
    got = sorted(tuple(r) for r in substring.digests(spark.createDataFrame(table, "doc_id long, text string")).collect())
    assert got == brute(table, 35)


def test_columns_of_any_name_and_repeated_rows(spark):
    same = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"a {same}", 1, 2, 3, 4), (1, f"a {same}", 1, 2, 3, 4), (1, f"b {same}", 5, 6, 7, 8), (2, None, 0, 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int, flag int, kept int, starts int")
    got = substring.without_repeats(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.mark) for r in got.collect() if r.text is not None) == [(1, "", 1), (1, "", 1), (1, "b", 5)]


def test_anchors_take_little_memory_beside_the_words():
    import tracemalloc

    import numpy as np

    lanes, doc = np.random.default_rng(3).integers(0, 1 << 63, (250_000, 2), np.uint64), np.zeros(250_000, np.int64)
    tracemalloc.start()
    start, at, grams = substring.anchors(lanes, doc, 35, 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 and len(start) == 250_000 - 34
    for i in (0, 16_383, 16_384, 100_000, len(start) - 1):
        assert at[i] == i + grams[i : i + 20].argmin()
