import numpy as np

from millrace.llm import chroma


def tune(seed, notes=60):
    rng = np.random.default_rng(seed)
    t = np.arange(400) / chroma.RATE
    parts = [np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) * np.hanning(400) for k in rng.integers(0, 30, notes)]
    return (8000 * np.concatenate(parts)).astype("<i2")


def test_alignment_matches_brute_force(spark):
    one, two = tune(1), tune(2)
    noisy = (one + np.random.default_rng(3).normal(0, 150, len(one))).astype("<i2")
    shifted = np.concatenate([tune(4, 12), one])
    audio = {0: one, 1: noisy, 2: shifted, 3: two, 50: two, 51: one[:500], 7: None}
    rows = [(k, None if x is None else x.tobytes(), 1) for k, x in audio.items()]
    media = spark.createDataFrame(rows, "rec_id long, audio binary, n_ints int")
    got = {r.rec_id: r for r in chroma.match(media).collect()}
    assert got[3].class_id == got[50].class_id == 3 and got[51].class_id == got[7].class_id == 7
    prints = {k: chroma.fingerprint(audio[k]).tolist() for k in (0, 1, 2, 3)}
    errors = {j: brute_errors(prints[0], prints[j]) for j in (1, 2, 3)}
    assert [j for j in errors if errors[j] <= chroma.MAX_BIT_ERROR] == [1, 2]
    assert got[0].n_links == 2 and got[50].n_links == 0 and got[1].n_links is None
    assert got[0].best_bit_error == round(min(errors.values()), 6) and errors[got[0].best_id] == min(errors.values())
    assert chroma.match(media.limit(0)).count() == 0


def test_vectors_as_recordings(spark):
    rows = [(1, [0.1] * 64), (2, [0.1] * 64), (3, None), (4, [None, float("nan")])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.rec_id: r for r in chroma.match(vectors, "vec_id", "embedding", chroma.tone).collect()}
    assert got[1].class_id == got[2].class_id == 1 and got[1].n_ints > 0 and got[3].n_ints == 0


def brute_errors(a, b):
    """Least bit error of two prints over all shifts that count."""
    least = 1.0
    for s in range(1 - len(b), len(a)):
        pairs = [(a[p], b[p - s]) for p in range(len(a)) if 0 <= p - s < len(b)]
        if len(pairs) >= chroma.LEAST_OVERLAP or sum(x == y for x, y in pairs) >= chroma.LEAST_COMMON:
            least = min(least, sum((x ^ y).bit_count() for x, y in pairs) / (32 * len(pairs)))
    return least


def test_recall_by_bit_error_alone(spark):
    rng = np.random.default_rng(6)
    audio = {}
    for k in range(6):
        audio[50 * k] = tune(20 + k, 30)
        for i, noise in enumerate((500, 2000, 3000, 4000)):
            audio[50 * k + 1 + i] = (audio[50 * k] + rng.normal(0, noise, len(audio[50 * k]))).clip(-32768, 32767).astype("<i2")
    media = spark.createDataFrame([(k, x.tobytes()) for k, x in audio.items()], "rec_id long, audio binary")
    prints = {k: chroma.fingerprint(x).tolist() for k, x in audio.items()}
    rows = spark.createDataFrame(list(prints.items()), "node long, ints array<long>")
    asked = [k for k in prints if k % 50 == 0]
    want = {(q, k): e for q in asked for k in prints if k != q and (e := brute_errors(prints[q], prints[k])) <= chroma.MAX_BIT_ERROR}
    found = chroma.alignments(rows, rows.where("node % 50 = 0").select("node")).collect()
    got = {(r.query, r.other): r.bit_error for r in found}
    assert len(want) > 15 and set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert sum(got[x] == want[x] for x in got) >= 0.9 * len(want) and any(r.common < chroma.LEAST_COMMON for r in found)
    links = {r.rec_id: r.n_links for r in chroma.match(media).collect()}
    assert {q: links[q] for q in asked} == {q: sum(a == q for a, _ in got) for q in asked}


def test_query_finds_the_renditions(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = chroma.match(chroma.synthetic(vectors, "vec_id", "embedding"), decode=chroma.sound).collect()
    assert len(rows) == vectors.count() + vectors.where("vec_id % 50 = 0").count()
    asked = {r.rec_id: r for r in rows if r.rec_id >= 0 and r.rec_id % 50 == 0 and r.n_ints}
    near = {}
    for r in vectors.where("vec_id % 50 = 0").collect():
        sound = chroma.tone(r.embedding)
        a, b = (chroma.fingerprint(x).tolist() for x in (sound, chroma.rendition(sound, r.vec_id)))
        near[r.vec_id] = brute_errors(a, b) <= chroma.MAX_BIT_ERROR
    of = {r.rec_id: r.class_id for r in rows}
    found = [k for k in asked if near[k] and asked[k].best_id == of[-1 - k]]
    assert sum(near.values()) >= 5 and len(found) >= 0.9 * sum(near.values())


def test_silence_ids_that_repeat_and_a_long_recording(spark):
    still, one = np.zeros(300_000, "<i2"), tune(1)
    rows = [(0, still), (50, still[:250_000]), (2, one), (2, tune(2)), (3, np.concatenate([still[:9000], one, still[:9000]])), (100, one)]
    media = spark.createDataFrame([(k, x.tobytes(), 0) for k, x in rows], "rec_id long, audio binary, node int")
    got = chroma.match(media).collect()
    assert len(got) == 6 and len({r.fp_sha256 for r in got}) == 5
    by = {(r.rec_id, r.n_ints): r for r in got}
    # Silence aligns with the longer silence, and with that at the ends of recording 3.
    assert {r.n_links for r in got if r.rec_id == 50} == {2} and {r.best_id for r in got if r.rec_id == 50} == {0}
    assert {r.best_id for r in got if r.rec_id == 100} == {3} and len(by) >= 5
