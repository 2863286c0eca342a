import random

import corpus_pipeline
from millrace.llm import copies, simhash


def shingles(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows):
    sets, label, changed = {k: shingles(t) for k, t in rows}, {k: k for k, _ in rows}, True
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in near:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def texts(seed):
    rng = random.Random(seed)
    line = " ".join(f"line{i}" for i in range(25))
    made = [None, "", " ", "one", "One", "a b c d", "a b c d e"]
    for k in range(30):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(8, 160))]
        made.append(" ".join(words) + (" " + line if k % 3 == 0 else ""))
        for _ in range(rng.randint(0, 5)):  # copies of copies, so that groups are chains, too
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
            made.append(" ".join(words) + (" " + line if k % 3 == 0 else ""))
    rng.shuffle(made)
    return made


def test_stage_drops_near_copies_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(copies, "SAMPLE_EVERY", 2)
    monkeypatch.setattr(copies, "COMMON", 3)
    rows = [(k, t, "a", "s", 0) for k, t in enumerate(texts(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    label = brute([(k, t) for k, t, *_ in rows])
    got = {r.doc_id: r.component_id for r in copies.near_copies(docs).collect()}
    assert got == label
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert kept == set(label.values())
    assert len(kept) < simhash.one_of_each(docs).count()


def test_stage_links_by_simhash_first(spark, monkeypatch):
    rng, rows = random.Random(7), []
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows.append((2 * k, " ".join(words)))
        words[rng.randrange(400)] = "changed"
        rows.append((2 * k + 1, " ".join(words)))
    prints = dict(zip(range(80), simhash.fingerprint_batch([t for _, t in rows]).tolist(), strict=True))
    close = {(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 5}
    assert len(close) >= 20
    taken = {}
    meetings, still_open = copies.meetings, copies.still_open

    def ball_links(posts, found):
        taken.setdefault("links", {tuple(sorted(r)) for r in found.collect()})
        return still_open(posts, found)

    def balls(nodes):
        taken["doc_of"] = {r.key: (r.doc_id, r.fp & (1 << 64) - 1) for r in nodes.collect()}
        return meetings(nodes)

    monkeypatch.setattr(copies, "meetings", balls)
    monkeypatch.setattr(copies, "still_open", ball_links)
    docs = spark.createDataFrame([(k, t, "a", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert dict(taken["doc_of"].values()) == prints
    assert {tuple(sorted(taken["doc_of"][x][0] for x in pair)) for pair in taken["links"]} >= close
    assert kept == set(brute(rows).values())


def test_many_alike_without_meeting(spark):
    """A large group of copies that all differ, which balls join in part only, is one group; its shared lines join no others."""
    rng = random.Random(8)
    base = [f"b{rng.randrange(3000)}" for _ in range(60)]
    rows = []
    for k in range(120):
        words = list(base)
        words[rng.randrange(56)] = f"own{k}"
        rows.append((k, " ".join(words)))
    rows += [(200 + k, " ".join(base[:20] + [f"o{k}x{i}" for i in range(30)])) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in copies.near_copies(docs).collect()}
    assert got == brute(rows)
