from millrace.llm import licences


def dice(a, b):
    a, b = (set(licences.bigram_set(licences.normal_words(x))) for x in (a, b))
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def brute(text):
    import re

    if text is None:
        return (0, "", 0.0)
    units = [*text.split("\n"), *[p for p in re.split(r"\n[ \t\r]*\n", text) if "\n" in p], text]
    units = {" ".join(licences.normal_words(u)) for u in units}
    found = [(n, dice(u, t)) for u in units for n, t in licences.TEMPLATES]
    found = [x for x in found if x[1] >= licences.THRESHOLD]
    return (len(found), ",".join(sorted({n for n, _ in found})), max([d for _, d in found], default=0.0))


def test_scan_matches_brute_force(spark):
    mit = licences.TEMPLATES[6][1]
    wrapped = mit.replace(", ", ",\n")
    texts = [None, "", "\n\n", "mit", "words\nReleased under the MIT License.\nmore", f"Title\n\n{wrapped}\n\nrest of it",
             wrapped.replace("software", "program", 1), wrapped.replace("without", "with"), "RELEASED  UNDER -- the mit license!",
             "Licensed under the Apache License, version 2.0 only", "Released under the MIT License. " * 2, "x " * 50000 + mit]
    rows = [(k, t, 3) for k, t in enumerate(texts + texts[4:6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_matches int")
    got = {r.doc_id: (r.n_matches, r.licences, r.best_dice) for r in licences.scan(docs).collect()}
    assert got == {k: brute(t) for k, t, _ in rows}
    assert licences.scan(docs.limit(0)).count() == 0
