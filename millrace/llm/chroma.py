"""Chroma audio fingerprints: packed integers from pitch-class frames, aligned by offset histograms and bit errors.

A recording (16-bit mono samples) becomes frames of energies of the 12 pitch classes. Over the integral image of frames and
classes, each of 16 rectangle filters compares two areas and gives 2 bits (Gray-coded, so a small change flips one); 32 bits
make one integer for each position. Two recordings are aligned at the offset of the least share of differing bits over the
overlap (the most equal integers, then the smallest offset, of equals), if that is MAX_BIT_ERROR at most. Offsets count
whose overlap has LEAST_OVERLAP positions, or LEAST_COMMON equal integers.

Offsets to verify come from an index: every integer is filed under each three of its four bytes, and a query's integer that
meets another there votes for an offset, unless the integers around (those of AROUND positions before and after that both
have) differ in over MOST_AROUND of their bits. Of a run of equal integers only the ends are filed, so a held note or
silence votes with its ends, not with every position against every other. The votes of a pair make its offset histogram;
every offset in it is verified over the whole overlap. Recall against all offsets of all pairs is measured by the tests.

Recordings with the same fingerprint are one class, represented by its smallest id, so copies are never paired with each
other; queries are the classes that hold an id divisible by QUERY_EVERY, against all classes.

Defined results: null audio and audio shorter than one filter's frames has an empty fingerprint; such recordings are one
class without alignments; repeated rows stay and share their class; rows that share an id but not their audio are of
different classes; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, may_have

RATE = 4000
FRAME, HOP = 1024, 256
LOW, HIGH = 60.0, 1900.0
#: Frames that a filter spans.
SPAN = 16
#: A quarter's bounds of a filter's log ratio.
BOUND = 0.35
QUERY_EVERY = 50
LEAST_COMMON = 3
LEAST_OVERLAP = SPAN
MAX_BIT_ERROR = 0.2
#: How far the integers stand that a vote is checked by, and the most of their bits that may differ.
AROUND, MOST_AROUND = (6, 12), 0.34


def filters() -> list[tuple[int, int, int, int, int]]:
    """(kind, first class, classes, first frame, frames): halves in time, halves in pitch, and middle against outside."""
    made = []
    for k in range(16):
        kind, classes, frames = k % 3, (2, 3, 4, 6)[k % 4], (4, 8, 12, 16)[(k // 4) % 4]
        made.append((kind, (5 * k) % (13 - classes), classes, (SPAN - frames) // 2, frames))
    return made


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames of 12 normalised pitch-class energies."""
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12))
    view = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[:: HOP]
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    use = np.flatnonzero((hz >= LOW) & (hz <= HIGH))
    pitch = np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % 12
    into = np.zeros((len(use), 12), np.float32)
    into[np.arange(len(use)), pitch] = 1
    energy = np.abs(np.fft.rfft(view * np.hanning(FRAME).astype(np.float32), axis=1)[:, use]) ** 2 @ into
    return energy / np.maximum(np.linalg.norm(energy, axis=1, keepdims=True), 1e-9)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer for each position at which the filters fit."""
    frames = chroma(samples)
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t: int, frames: int, c: int, classes: int) -> np.ndarray:
        a, b = at + t, at + t + frames
        return image[b, c + classes] - image[a, c + classes] - image[b, c] + image[a, c]

    out = np.zeros(n, np.uint32)
    for kind, c, classes, t, size in filters():
        whole = area(t, size, c, classes)
        if kind == 0:
            part = area(t, size // 2, c, classes)
        elif kind == 1:
            part = area(t, size, c, classes // 2)
        else:
            part = area(t + size // 4, size // 2, c, classes)
        ratio = np.log((part + 0.01) / (whole - part + 0.01))
        level = np.digitize(ratio, [-BOUND, 0.0, BOUND]).astype(np.uint32)
        out = out << np.uint32(2) | level ^ level >> np.uint32(1)
    return out


def pcm(raw: bytes | None) -> np.ndarray:
    """Samples of little-endian 16-bit mono audio at RATE; an odd last byte is left out."""
    return np.frombuffer(raw[: len(raw) // 2 * 2], "<i2") if raw else np.zeros(0, np.int16)


#: Recordings whose integers a task holds before it gives them on.
PART = 512


def prints(media: DataFrame, key: str = "rec_id", audio: str = "audio", decode=pcm) -> DataFrame:
    """(rec_id, ints, fp_sha256) of recordings; ``decode`` gives the samples of a value of the audio column."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, PART):
                part = batch.slice(i, PART)
                made = [fingerprint(decode(raw.as_py())) for raw in part.column(1)]
                rows = [part.column(0), pa.array([x.astype(np.int64) for x in made], pa.list_(pa.int64()))]
                rows.append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in made]))
                yield pa.RecordBatch.from_arrays(rows, ["rec_id", "ints", "fp_sha256"])

    read = media.select(media[key].cast("long").alias("rec_id"), media[audio].alias("audio"))
    return read.mapInArrow(run, "rec_id long, ints array<long>, fp_sha256 string")


PLACES = [sign * k for k in AROUND for sign in (-1, 1)]


def posts(classes: DataFrame) -> DataFrame:
    """(node, key, at, around) from (node, ints): what is filed in the index, around being the integers at PLACES."""
    i = F.sequence(F.lit(0), F.size("ints") - 1)
    ends = F.filter(
        i, lambda k: F.coalesce(F.get("ints", k) != F.get("ints", k - 1), F.lit(True)) | F.coalesce(F.get("ints", k) != F.get("ints", k + 1), F.lit(True))
    )
    filed = classes.where("size(ints) > 0").select("node", "ints", F.explode(ends).alias("at"))
    own = F.get("ints", F.col("at"))
    keys = F.array(*[own.bitwiseAND(F.lit(0xFFFFFFFF ^ 0xFF << 8 * byte)) + F.lit(byte << 32) for byte in range(4)])
    around = [F.get("ints", F.col("at") + k).alias(f"a{n}") for n, k in enumerate(PLACES)]
    return filed.select("node", F.explode(keys).alias("key"), "at", *around)


def candidates(classes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, other, shifts): the offset histograms' places, of query nodes against all others."""
    asked = posts(classes.join(queries, "node", "left_semi")).withColumnsRenamed({"node": "query", "at": "q_at"})
    asked = durable(asked.withColumnsRenamed({f"a{n}": f"q{n}" for n in range(len(PLACES))}), "asked")
    others = may_have(posts(classes), asked, "key").withColumnRenamed("node", "other")
    pairs = [(F.col(f"a{n}"), F.col(f"q{n}")) for n in range(len(PLACES))]
    wrong = sum((F.coalesce(F.bit_count(a.bitwiseXOR(q)), F.lit(0)) for a, q in pairs), F.lit(0))
    seen = sum((F.when(a.isNotNull() & q.isNotNull(), 32).otherwise(0) for a, q in pairs), F.lit(0))
    votes = others.join(asked, "key").where("other != query").where(wrong <= MOST_AROUND * seen)
    return votes.groupBy("query", "other").agg(F.collect_set(F.col("q_at") - F.col("at")).alias("shifts"))


def best_shift(a: np.ndarray, b: np.ndarray, shifts) -> tuple[float, int, int] | None:
    """(bit error, -equal integers, shift) of the best of the shifts at which two prints align; a[i + shift] stands against
    b[i]."""
    best = None
    for shift in shifts:
        first_a, first_b = max(shift, 0), max(-shift, 0)
        length = min(len(a) - first_a, len(b) - first_b)
        if length < 1:
            continue
        bits = np.bitwise_count(a[first_a : first_a + length] ^ b[first_b : first_b + length])
        error, common = int(bits.sum()) / (32.0 * length), int((bits == 0).sum())
        if error <= MAX_BIT_ERROR and (length >= LEAST_OVERLAP or common >= LEAST_COMMON):
            found = (error, -common, shift)
            best = found if best is None else min(best, found)
    return best


ALIGNED = "query long, other long, shift int, common long, bit_error double"


def alignments(classes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, other, shift, common, bit_error) of query nodes with every other node they align with.

    ``classes`` is (node, ints), ``queries`` (node); nodes are unique.
    """
    pairs = durable(candidates(classes, queries), "pairs")
    ends = pairs.select("query", "other", "shifts")
    left = classes.select(F.col("node").alias("query"), F.col("ints").alias("a"))
    right = classes.select(F.col("node").alias("other"), F.col("ints").alias("b"))

    def run(batches):
        for batch in batches:
            rows = []
            for query, other, shifts, a, b in zip(*batch.columns, strict=True):
                prints = [x.values.to_numpy(zero_copy_only=False).astype(np.uint32) for x in (a, b)]
                if best := best_shift(*prints, shifts.as_py()):
                    rows.append((query.as_py(), other.as_py(), best[2], -best[1], best[0]))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()]
            names = [part.split()[0] for part in ALIGNED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    read = ends.join(left, "query").join(right, "other").select("query", "other", "shifts", "a", "b")
    return read.mapInArrow(run, ALIGNED)


def match(media: DataFrame, key: str = "rec_id", audio: str = "audio", decode=pcm) -> DataFrame:
    """Per recording: rec_id, n_ints, fp_sha256, class_id, and of its class, where that is a query, n_links (other classes
    it aligns with) and the best of them: best_id, best_shift, best_bit_error (null where there is none)."""
    made = durable(prints(media, key, audio, decode), "prints")
    classes = made.groupBy("fp_sha256").agg(
        F.min("rec_id").alias("class_id"), F.first("ints").alias("ints"), F.max(F.expr(f"rec_id % {QUERY_EVERY} = 0")).alias("asked")
    )
    classes = durable(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    filled = classes.where("size(ints) > 0 and class_id is not null")
    found = alignments(filled.select("node", "ints"), filled.where("asked").select("node"))
    named = found.join(classes.select(F.col("node").alias("other"), F.col("class_id").alias("other_id")), "other")
    best = F.min(F.struct("bit_error", "other_id", "shift")).alias("best")
    links = named.groupBy("query").agg(F.count("*").alias("n_links"), best)
    known = durable(
        classes.join(links, classes["node"] == links["query"], "left").select("fp_sha256", "class_id", "asked", "n_links", "best"), "known"
    )
    return made.join(known, "fp_sha256").select(
        "rec_id",
        F.size("ints").cast("long").alias("n_ints"),
        "fp_sha256",
        "class_id",
        F.when(F.col("asked"), F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.col("best.other_id").alias("best_id"),
        F.col("best.shift").cast("long").alias("best_shift"),
        F.round("best.bit_error", 6).alias("best_bit_error"),
    )


NOTE = 240


def tone(vector: list[float] | None) -> np.ndarray:
    """A vector of ``embeddings`` as a recording, one note for each of its numbers."""
    t = np.arange(NOTE) / RATE
    x = np.array([0.0 if v is None or not np.isfinite(v) else v for v in vector or []], np.float64)
    note = np.round(24 * np.tanh(3 * x))[:, None]
    return (12000 * np.sin(2 * np.pi * 330.0 * 2 ** (note / 12) * t) * np.hanning(NOTE)).astype(np.int16).ravel()


#: Deviation of the noise of a rendition, against a peak of 12,000.
NOISE = 1000


def rendition(samples: np.ndarray, seed: int) -> np.ndarray:
    """Another take of a recording: its ends cut off, begun later, with noise; the same for the same seed."""
    rng = np.random.default_rng(seed)
    cut = samples[len(samples) // 9 + 37 : len(samples) - len(samples) // 9]
    late = np.concatenate([np.zeros(int(rng.integers(100, 900))), cut])
    return np.clip(late + rng.normal(0, NOISE, len(late)), -32768, 32767).astype(np.int16)


def synthetic(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(rec_id, audio) of vectors, for ``sound``, and of a rendition of each query's.

    The synthetic tables hold no audio; tones of different vectors don't come near each other, so the renditions (ids
    -1 - id) are what there is to find.
    """
    rows = vectors.select(vectors[key].cast("long").alias("rec_id"), vectors[vector].alias("vector"))
    takes = rows.where(f"rec_id % {QUERY_EVERY} = 0").select((-1 - F.col("rec_id")).alias("rec_id"), "vector")
    both = rows.withColumn("take", F.lit(False)).unionByName(takes.withColumn("take", F.lit(True)))
    return both.select("rec_id", F.struct("rec_id", "vector", "take").alias("audio"))


def sound(row: dict) -> np.ndarray:
    """Samples of a row of ``synthetic``."""
    samples = tone(row["vector"])
    return rendition(samples, -1 - row["rec_id"]) if row["take"] else samples
