import random
import zlib

import pytest

from millrace.llm import langid, toxicity


def held(k):
    return zlib.crc32(str(k).encode()) % 5 == 0


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(500):
        lang = "ab"[k % 2]
        text = words(rng, "abcdeé" if lang == "a" else "vwxyzd", rng.randint(5, 120))
        toxic = int(k % 7 == 0)
        if toxic:
            text = text[:40] + " nastyword " + text[40:] + " Vileword nastyword"
        rows.append((k, text, lang, "s"))
        labels.append((k, toxic, 1))
    rows += [(1000, None, "a", "s"), (1001, "", "a", "s"), (1002, "12 !! \x00", None, "s"), (1003, "nastyword " * 30000, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int, text int")


def test_toxicity(documents):
    docs, labels = documents
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(got) == 504 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    tests = [k for k in range(500) if held(k)]
    assert {k for k, r in got.items() if r.held_out} == {k for k in got if held(k)}
    assert sum(got[k].predicted == (k % 7 == 0) for k in tests) >= 0.95 * len(tests)
    assert got[1000].score == got[1001].score and got[1003].predicted == 1
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if not r.predicted}


def test_toxicity_without_labels(documents):
    docs, labels = documents
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.keep_clean(docs, few).count() == 504
    assert toxicity.keep_clean(docs.limit(0), labels).count() == 0


def test_language(documents):
    docs, _ = documents
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    tests = [k for k in range(500) if held(k)]
    assert sum(got[k].lang_pred == "ab"[k % 2] for k in tests) >= 0.97 * len(tests)
    for k in (1000, 1001, 1002):
        assert (got[k].lang_pred, got[k].score) == ("und", 0)
    kept = {r.doc_id for r in langid.keep_identified(docs).collect()}
    assert not kept & {1000, 1001, 1002} and len(kept) >= 490


def test_language_without_labels(documents):
    docs, _ = documents
    bare = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in langid.predict(bare, langid.fit(bare)).collect()} == {"und"}
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0))).count() == 0


def test_windows_cover_the_whole_text():
    text = "é" * 1000 + "x"
    rows, sizes = langid.windows(text)
    assert bytes(rows.ravel()[rows.ravel() < 256].astype("uint8").tolist()).decode() == text and sizes.sum() == 2001
