import random
import re

import pytest
import xxhash

from millrace.llm import copies, simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(3, len(words))
    made = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in made]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = {k: brute_print(t) for k, t in rows}
    label = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return {k: (f"{prints[k]:016x}", label[k]) for k in prints}


def texts(seed):
    rng = random.Random(seed)
    vocabulary = ["Ab", "cd", "É", "x", "yz,", "Q"]
    made = ["", None, "  \n", "one", "one two", "\x1cA\x85b c", "A B C"]
    made += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6))) for _ in range(80)]
    return made + made[:20]


@pytest.mark.parametrize("block", [4, 1 << 17])
def test_fingerprints(monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    made = texts(1) + [" ".join(str(i % 7) for i in range(50))]
    assert simhash.fingerprint_batch(made).tolist() == [brute_print(t) for t in made]


def test_components_match_brute_force(spark):
    rows = list(enumerate(texts(2)))
    docs = spark.createDataFrame([(k, t, "u") for k, t in rows], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.digests(docs).collect()}
    assert got == brute_components(rows)
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert kept == {c for _, c in got.values()}


def test_empty_table(spark):
    assert simhash.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_row_of_each_component_stays_whatever_its_id(spark):
    a, b = "alpha beta gamma delta", "totally different words stand here"
    rows = [(1, a, 1), (5, a, 2), (5, b, 3), (9, "x", 4), (9, "x", 4), (9, "x", 5), (None, "own text of no id", 6), (None, "x", 7), (12, None, 8), (3, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    for one_of_each in (simhash.one_of_each, copies.one_of_each):
        kept = one_of_each(docs)
        assert kept.columns == docs.columns
        got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
        assert got == sorted([(1, a), (5, b), (9, "x"), (None, "own text of no id"), (3, "")], key=str)
        assert one_of_each(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    text = "many words " * 200_000
    docs = spark.createDataFrame([(1, text), (2, text + "x"), (3, text)], "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.digests(docs).collect()}
    assert got[1].fingerprint == f"{brute_print('many words ' * 3):016x}" and got[3].component_id == 1


def test_meetings_join_all_within_five_bits(spark):
    rng, prints = random.Random(9), [0, (1 << 64) - 1, 1 << 63]
    for _ in range(150):
        x = rng.getrandbits(64)
        prints += [x, x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7)))]
    rows = [(k, x - (1 << 64) if x >> 63 else x) for k, x in enumerate(prints)]
    met = {(r.u, r.v) for r in simhash.meetings(spark.createDataFrame(rows, "key long, fp long")).collect()}
    close = {(b, a) for a, x in enumerate(prints) for b, y in enumerate(prints) if a < b and (x ^ y).bit_count() <= 5}
    assert close <= met and all(u > v for u, v in met)
    near = {0} | {1 << a | 1 << b for a in range(32) for b in range(32)}
    assert all(any((prints[u] ^ prints[v]) >> s & (1 << 32) - 1 in near for s in (0, 32)) for u, v in met)
