"""Exact removal of repeated passages with a log-structured fingerprint index.

Every window of WINDOW words is represented by an anchor: the hash of that GRAM-word sequence in it whose hash is least
(the leftmost of equals). Equal windows have equal anchors, and neighbouring windows mostly share theirs, so a twelfth of
the hashes stand for all windows. The index is a set of immutable runs of anchors (hash, doc_id, mark), each sorted by
hash. A new batch is merge-joined with the runs before it: anchors that it brings and that occur twice or more, there or in
itself, make candidates of the batch's documents and of earlier ones. Their windows on such anchors are verified by two
independent fingerprints (64 bits each) of all the words, which decide alone what is repeated; then the batch's anchors are
appended as a run, and runs are compacted as they become many. What is found for earlier documents is added to what they
had, so the results after any number of batches, in any order, are those of all documents at once. No window is capped or
sampled.

Defined results: a null or wordless text has no words and stays as it is; texts under WINDOW words lose nothing; repeated
rows repeat each other's windows, so both lose them; words are kept unchanged and joined by one space.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, flagged, forget, map_texts, marked, may_have, release, shared_folder, subfolders, unused

WINDOW = 35
GRAM = 16
#: Batches in which op9 adds its table to the index, and runs above which it compacts.
BATCHES, RUNS_OF_TABLE = 2, 1
#: Runs above which an index compacts, where nothing else is said.
MOST_RUNS = 8
#: Distinct words that a task remembers before it starts afresh.
CACHE_WORDS = 200_000
#: Bytes of text that are split into words at once.
WORD_BYTES = 1 << 20
#: Windows whose anchors are sought at once.
PLACES = 1 << 14
BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class Words:
    """Words of texts as two lanes of 64-bit hashes."""

    def __init__(self):
        self._reset()

    def _reset(self) -> None:
        self.seen: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.lanes = np.zeros((0, 2), np.uint64)

    def hashes(self, split: list[list[bytes]]) -> np.ndarray:
        import xxhash

        if len(self.seen) > CACHE_WORDS:
            self._reset()
        known, codes = len(self.seen), []
        for words in split:
            codes += map(self.seen.__getitem__, words)
        if len(self.seen) > known:
            raw = b"".join(map(xxhash.xxh3_128_digest, list(self.seen)[known:]))
            self.lanes = np.concatenate([self.lanes, np.frombuffer(raw, np.uint64).reshape(-1, 2)])
        return self.lanes[np.array(codes, np.int64)]


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes: only ASCII white space


def rolled(lane: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    n = len(lane) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in range(size if n > 0 else 0):
        out *= base
        out += lane[j : j + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(29)
    return out


def anchors(lanes: np.ndarray, doc: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within one document, the place of each window's anchor, and the hash at every place."""
    n = len(doc) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = rolled(lanes[:, 0], gram, BASE[0])
    start = np.flatnonzero(doc[window - 1 :] == doc[:n])
    view = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    at = np.empty(len(start), np.int64)
    for i in range(0, len(start), PLACES):
        part = start[i : i + PLACES]
        at[i : i + PLACES] = part + view[part].argmin(axis=1)
    return start, at, grams


def lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Values, sorted by owner, as one list for each of n owners."""
    ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def sketches(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, mark, n_words, whole_sha256, hashes): the anchors of each document, one for each place."""

    def make():
        table = Words()

        def call(keys: list, texts: list, marks: list) -> dict:
            split = [split_words(t) for t in texts]
            sizes = [len(w) for w in split]
            doc = np.repeat(np.arange(len(split)), sizes)
            _, at, grams = anchors(table.hashes(split), doc, window, gram)
            at = np.unique(at)
            return {
                "doc_id": keys,
                "mark": marks,
                "n_words": sizes,
                "whole_sha256": [hashlib.sha256(b" ".join(w)).hexdigest() for w in split],
                "hashes": lists(grams[at].view(np.int64), doc[at], len(split), pa.int64()),
            }

        return call

    schema = "doc_id long, mark long, n_words long, whole_sha256 string, hashes array<long>"
    return map_texts(marked(docs), make, schema, limit=WORD_BYTES, more=("mark",))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])


class PassageIndex:
    """Sorted immutable runs of anchors in a shared folder, with the sketches and findings of each batch.

    A state (which files count) is written after everything it names, so an index can be opened again from its path, and a
    batch that fails leaves the state before it. Texts aren't kept: ``add`` looks them up in the corpus it is given.
    """

    RUN = "hash long, doc_id long, mark long"
    SKETCH = "doc_id long, mark long, n_words long, whole_sha256 string, hashes array<long>"
    FOUND = "doc_id long, mark long, starts array<int>"

    def __init__(self, spark: SparkSession, path: str | None = None, most_runs: int = MOST_RUNS, window: int = WINDOW, gram: int = GRAM):
        self.spark, self.most_runs, self.window, self.gram = spark, most_runs, window, gram
        self.path = path or f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
        self.files: dict[str, list[str]] = {"runs": [], "sketches": [], "found": []}
        self.states = 0
        if path and (numbers := [int(x.rsplit("-", 1)[1]) for x in subfolders(spark, path, "state-")]):
            self.states = max(numbers)
            row = spark.read.schema("runs array<string>, sketches array<string>, found array<string>").json(f"{path}/state-{self.states}").first()
            self.files = {k: list(row[k] or []) for k in self.files}

    def _commit(self) -> None:
        self.states += 1
        row = self.spark.createDataFrame([tuple(self.files.values())], "runs array<string>, sketches array<string>, found array<string>")
        row.coalesce(1).write.json(f"{self.path}/state-{self.states}")

    def _write(self, df: DataFrame, kind: str) -> str:
        to = f"{self.path}/{kind}-{uuid.uuid4().hex}"
        df.write.parquet(to)
        release(self.spark)
        return to

    @staticmethod
    def _sorted(posts: DataFrame) -> DataFrame:
        """In the order of the hash, by ranges that split a hash that very many documents have."""
        return posts.repartitionByRange("hash", "doc_id", "mark").sortWithinPartitions("hash", "doc_id", "mark")

    def _read(self, kind: str, schema: str) -> DataFrame:
        files = self.files[kind]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        return self._read("runs", self.RUN)

    def sketches(self) -> DataFrame:
        return self._read("sketches", self.SKETCH)

    def found(self) -> DataFrame:
        """(doc_id, mark, starts) of the documents with repeated windows, of one for each sequence of words."""
        return self._read("found", self.FOUND).groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("starts")).alias("starts"))

    def add(self, batch: DataFrame, corpus: DataFrame) -> None:
        """Take a batch in. ``corpus`` has the texts of all documents taken in so far, and of the batch."""
        earlier = self.sketches().select("whole_sha256")
        sketch = self._write(sketches(batch, self.window, self.gram), "sketch")
        long = self.spark.read.schema(self.SKETCH).parquet(sketch).where(F.col("n_words") >= self.window)
        # Rows with the same words repeat each other wholly, so one of them stands for all in the search of windows.
        one = F.min(F.struct("doc_id", "mark", "hashes")).alias("one")
        fresh = long.groupBy("whole_sha256").agg(one)
        if self.files["sketches"]:
            fresh = fresh.join(earlier, "whole_sha256", "left_anti")
        posts = fresh.select("one.doc_id", "one.mark", F.explode("one.hashes").alias("hash")).select("hash", "doc_id", "mark")
        run = self._write(self._sorted(posts), "run")
        own = self.spark.read.schema(self.RUN).parquet(run)
        repeated = durable(self._shared(own), "repeated")
        both = own.unionByName(self.runs())
        hits = may_have(both, repeated, "hash").join(repeated.hint("merge"), "hash")
        hits = durable(hits.groupBy("doc_id", "mark").agg(F.collect_set("hash").alias("hashes")), "hits")
        found = self._verify(hits, corpus)
        files = {"runs": [*self.files["runs"], run], "sketches": [*self.files["sketches"], sketch]}
        self.files = files | {"found": [*self.files["found"], self._write(found, "found")]}
        self._commit()
        for done in (repeated, hits):
            forget(done)
        if len(self.files["runs"]) > self.most_runs:
            self.compact()

    def _shared(self, own: DataFrame) -> DataFrame:
        """Hashes of a batch that occur twice or more in it and the runs before it: a merge join."""
        new = own.groupBy("hash").agg(F.count("*").alias("n"))
        if not self.files["runs"]:
            return new.where("n > 1").select("hash")
        old = self.runs().groupBy("hash").agg(F.count("*").alias("n_old"))
        return new.join(old.hint("merge"), "hash", "left").where("n + coalesce(n_old, 0) > 1").select("hash")

    def _verify(self, hits: DataFrame, corpus: DataFrame) -> DataFrame:
        """(doc_id, mark, starts): windows on the hashes of the hits that are found twice among them, by all their words."""
        texts = flagged(marked(corpus), hits, "doc_id", "mark", "flag").where("flag")
        # A row that is there twice counts twice; it has lost all its words as a twin of itself.
        texts = texts.join(hits, same_row(texts, hits)).select(texts["doc_id"], texts["mark"], "text", "hashes")
        candidates = durable(texts, "candidates")
        every = windows(candidates, self.window, self.gram)
        twice = durable(every.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "twice")
        some = may_have(every, twice, "h1").join(twice, ["h1", "h2"])
        starts = durable(some.groupBy("doc_id", "mark").agg(F.collect_list("start").alias("starts")), "starts")
        for done in (candidates, twice):
            forget(done)
        return starts

    def compact(self) -> None:
        """Merge all runs into one. The old runs' files are left: a reader may still be at them."""
        if len(self.files["runs"]) > 1:
            run = self._write(self._sorted(self.runs()), "run")
            self.files = self.files | {"runs": [run]}
            self._commit()


def windows(candidates: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, mark, start, h1, h2): each window of the candidates (doc_id, mark, text, hashes) on one of the hashes."""

    def make():
        table = Words()

        def call(keys: list, texts: list, marks: list, hashes: list):
            split = [split_words(t) for t in texts]
            doc = np.repeat(np.arange(len(split)), [len(w) for w in split])
            lanes = table.hashes(split)
            start, at, grams = anchors(lanes, doc, window, gram)
            # A hash counts for its own document, but one that another document of the batch brings is repeated, too.
            wanted = np.unique(np.concatenate([np.array(h, np.int64) for h in hashes] or [np.zeros(0, np.int64)]))
            start = start[np.isin(grams[at].view(np.int64), wanted)] if len(start) else start
            h1 = rolled(lanes[:, 0], window, BASE[0])[start].view(np.int64)
            h2 = rolled(lanes[:, 1], window, BASE[1])[start].view(np.int64)
            first = np.r_[0, np.cumsum([len(w) for w in split])]
            owner = doc[start] if len(start) else start
            key, mark = (pa.array(x, pa.int64()).take(pa.array(owner)) for x in (keys, marks))
            for i in range(0, len(start), 1 << 18):
                part = slice(i, i + (1 << 18))
                at = (start - first[owner])[part].astype(np.int32)
                yield {"doc_id": key[part], "mark": mark[part], "start": at, "h1": h1[part], "h2": h2[part]}

        return call

    return map_texts(candidates, make, "doc_id long, mark long, start int, h1 long, h2 long", limit=WORD_BYTES, more=("mark", "hashes"))


def removed(n: int, starts: list[int] | None, window: int) -> np.ndarray:
    """Which of n words a window at one of the starts covers."""
    edge = np.zeros(n + 1, np.int64)
    at = np.array(starts or [], np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge)[:n] > 0


def indexed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> PassageIndex:
    """A new index of all documents, taken in by batches."""
    index = PassageIndex(docs.sparkSession, most_runs=RUNS_OF_TABLE, window=window, gram=gram)
    for k in range(batches):  # every document is in one of the batches
        index.add(docs.where(F.pmod(F.xxhash64(docs["doc_id"]), F.lit(batches)) == k), docs)
    return index


def repeats(index: PassageIndex) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: sketches of all documents; (whole_sha256) of the word sequences that several rows have, of a window
    at least; (doc_id, mark, starts) of the documents with repeated windows, one for each sequence of words."""
    window = index.window
    sketch = index.sketches()
    long = sketch.where(F.col("n_words") >= window)
    twins = long.groupBy("whole_sha256").agg(F.count("*").alias("copies")).where("copies > 1").select("whole_sha256")
    return sketch, twins, durable(index.found(), "found")


def changes(docs: DataFrame, index: PassageIndex, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sketches of all documents, and (doc_id, mark, n_removed, kept) of each that loses words.

    kept is the text of the words that stay, joined by one space, or with ``digest`` its SHA-256.
    """
    sketch, twins, found = repeats(index)
    window = index.window
    texts = flagged(marked(docs), found, "doc_id", "mark", "flag").where("flag")
    hit = texts.join(found, same_row(texts, found)).select(texts["doc_id"], texts["mark"], "text", "starts")

    def make():
        def call(keys: list, texts: list, marks: list, starts: list) -> dict:
            out = {"doc_id": keys, "mark": marks, "n_removed": [], "kept": []}
            for text, at in zip(texts, starts, strict=True):
                words = split_words(text)
                gone = removed(len(words), at, window)
                out["n_removed"].append(int(gone.sum()))
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                out["kept"].append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
            return out

        return call

    some = map_texts(hit, make, "doc_id long, mark long, n_removed long, kept string", more=("mark", "starts"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest() if digest else "").alias("kept")
    whole = sketch.join(twins, "whole_sha256").select("doc_id", "mark", F.col("n_words").alias("n_removed"), nothing)
    # One that stands for its copies is in both tables: there it loses everything.
    most = F.max(F.struct("n_removed", "kept")).alias("most")
    return sketch, some.unionByName(whole).groupBy("doc_id", "mark").agg(most).select("doc_id", "mark", "most.*")


def digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, index: PassageIndex | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space. ``docs`` are those
    of the index, or get a new one."""
    sketch, changed = changes(docs, index or indexed(docs, window, gram), digest=True)
    changed = changed.withColumnRenamed("kept", "kept_sha256")
    return sketch.join(changed, same_row(sketch, changed), "left").select(
        sketch["doc_id"],
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, index: PassageIndex | None = None) -> DataFrame:
    """``docs`` with the repeated passages taken out of text; texts that have none are as they were. ``docs`` are those of
    the index, or get a new one."""
    _, changed = changes(docs, index or indexed(docs, window, gram))
    mark, flag = unused(docs, "mark"), unused(docs, "flag")
    new, own_id, own_mark = unused(docs, "kept"), unused(docs, "changed_id"), unused(docs, "changed_mark")
    changed = durable(changed.select(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark), F.col("kept").alias(new)), "changed")
    few = changed.select(F.col(own_id).alias("doc_id"), F.col(own_mark).alias("mark"))
    own = flagged(docs.withColumn(mark, F.xxhash64(docs["text"].cast("string"))), few, "doc_id", mark, flag)
    maybe = own.where(flag)
    joined = maybe.join(changed, maybe["doc_id"].eqNullSafe(changed[own_id]) & (maybe[mark] == changed[own_mark]), "left")
    now = [F.coalesce(new, maybe["text"]).alias("text") if c == "text" else maybe[c] for c in docs.columns]
    return own.where(~F.col(flag)).select(*docs.columns).unionByName(joined.select(now))
