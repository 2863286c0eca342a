"""Shortest-pack-first packing of token sequences over the length histogram.

A document's ids (with a closing id) are cut into full pieces and a rest, so cutting needs no plan. The histogram of piece
lengths, at most CAPACITY numbers whatever the input, goes to the driver; there lengths are placed longest first, each
into the packs with most room, updating counts of packing patterns rather than packs. The patterns (bounded by the
capacity as well) are joined back to the pieces by rank: the r-th piece of a length takes the r-th place that the patterns
have for it. Ranks are counted in shards of a length and shifted by the counts of earlier shards, so no length, however
common, meets in one task.

Defined results: a null or empty text is one piece of the closing id; a longer text has a piece for each full CAPACITY
ids; repeated rows are packed each for itself; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, map_texts
from .pieces import Merges

CAPACITY = 4096
CLOSING = 2
#: Distinct words that a task remembers before it starts afresh.
CACHE_WORDS = 500_000
#: Pieces of one shard, about, within which ranks are counted.
SHARD_ROWS = 50_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it can be seen, else the next one
    from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in seen else next(rest)) for b in range(256)]


class WordTokenizer:
    """Ids of whole texts. Tokens never reach over white space, so each distinct word is tokenised once.

    The vocabulary is lower-case, so words that differ in ASCII case are one. Words of Latin letters, with full stops or
    commas after them or not, go through vectorised merge rounds; all others through the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pairs = {(vocabulary[a], vocabulary[b]): r for r, (a, b) in reversed(list(enumerate(merges)))}
        self.merges = Merges(pairs, [vocabulary[a + b] for a, b in merges], max(vocabulary.values()) + 1)
        self.inner = np.array([vocabulary[c] for c in byte_symbols()], np.int32)
        self.final = np.array([vocabulary[c + "</w>"] for c in byte_symbols()], np.int32)
        self._reset()

    def _reset(self) -> None:
        self.seen: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    @staticmethod
    def plain(word: bytes) -> bool:
        """Whether a word has only lower-case Latin letters, which the vocabulary's normalisation leaves alone."""
        if word.isascii():
            return word.isalpha() and word.islower()
        text = word.decode()
        return text.isalpha() and max(text) < "\u0180" and text.lower() == text

    def _letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        last = np.cumsum(sizes) - 1
        sym[last] = self.final[raw[last]]
        sym, word = self.merges.merged(sym, np.repeat(np.arange(len(words), dtype=np.int32), sizes))
        return sym, np.bincount(word, minlength=len(words))

    def _tokenise(self, words: list[bytes]) -> None:
        letters: defaultdict[bytes, int] = defaultdict(count().__next__)
        others: defaultdict[bytes, int] = defaultdict(count().__next__)
        first, second, nothing = [], [], others[b""]
        for w in words:
            base = w.rstrip(b".,")
            if base and self.plain(base):
                first.append(-1 - letters[base])
                second.append(nothing if len(base) == len(w) else others[w[len(base) :]])
            else:
                first.append(others[w])
                second.append(nothing)
        made = []
        for i in range(0, len(keys := list(others)), 4096):
            part = [w.decode() for w in keys[i : i + 4096]]
            made += [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        flat = [np.array([x for ids in made for x in ids], np.uint32)]
        sizes = np.array([len(ids) for ids in made], np.int64)
        if letters:
            ids, own = self._letters(list(letters))
            flat.append(ids.astype(np.uint32))
            sizes = np.concatenate([sizes, own])
        ends = np.r_[0, np.cumsum(sizes)]
        a = np.array(first, np.int64)
        a = np.where(a < 0, len(made) - 1 - a, a)
        entry = np.column_stack([a, np.array(second, np.int64)]).ravel()
        taken = ends[entry + 1] - ends[entry]
        upto = np.r_[0, np.cumsum(taken)]
        self.flat = np.concatenate([self.flat, np.concatenate(flat)[np.repeat(ends[entry] - upto[:-1], taken) + np.arange(upto[-1])]])
        self.ends = np.concatenate([self.ends, self.ends[-1] + upto[2::2]])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.seen) > CACHE_WORDS:
            self._reset()
        known, codes, words = len(self.seen), [], [0]
        for text in texts:
            raw = (text or "").encode()
            if b"<|" not in raw:  # names of special tokens have a case
                raw = raw.lower()
            codes += map(self.seen.__getitem__, raw.split())  # ASCII letters, ASCII white space
            words.append(len(codes))
        if len(self.seen) > known:
            self._tokenise(list(self.seen)[known:])
        code = np.array(codes, np.int64)
        size = self.ends[code + 1] - self.ends[code]
        upto = np.r_[0, np.cumsum(size)]
        ids = self.flat[np.repeat(self.ends[code] - upto[:-1], size) + np.arange(upto[-1])]
        cut = upto[words]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """Each document's pieces of at most ``capacity`` ids."""

    def make():
        words = WordTokenizer(tokenizer)

        def call(keys: list, texts: list) -> dict:
            out: dict[str, list] = {"doc_id": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": []}
            for k, ids in zip(keys, words.encode(texts), strict=True):
                ids = np.append(ids, np.uint32(CLOSING)).astype("<u4")
                for a in range(0, len(ids), capacity):
                    part = ids[a : a + capacity]
                    row = (k, a, len(part), zlib.crc32(part.tobytes()), len(ids))
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
            return out

        return call

    return map_texts(docs, make, PIECE, key)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns (number of packs, [(length, how many in each pack), longest first])."""
    open_packs: dict[int, list[tuple[int, tuple | None]]] = defaultdict(list)  # by room
    rooms: list[int] = []

    def put(room: int, packs: int, pattern: tuple | None) -> None:
        if room not in open_packs:
            heapq.heappush(rooms, -room)
        open_packs[room].append((packs, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or -rooms[0] < length:
                times = min(left, capacity // length)  # new packs, as few as hold what is left
                put(capacity - times * length, left // times, (None, length, times))
                left %= times
                continue
            room = -rooms[0]
            packs, pattern = open_packs[room].pop()
            if not open_packs[room]:
                del open_packs[room]
                heapq.heappop(rooms)
            if packs > left:
                put(room, packs - left, pattern)
                packs = left
            next_room = -rooms[0] if rooms else 0
            times = max(1, min(room // length, left // packs, (room - next_room) // length + 1))
            put(room - times * length, packs, (pattern, length, times))
            left -= packs * times
    made = []
    for packs, pattern in (x for room in sorted(open_packs) for x in open_packs[room]):
        parts: list[tuple[int, int]] = []
        while pattern:
            pattern, length, times = pattern
            if parts and parts[-1][0] == length:
                parts[-1] = (length, parts[-1][1] + times)
            else:
                parts.append((length, times))
        made.append((packs, parts[::-1]))
    return made


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan as arrays, sorted by length and first rank: which ranks of a length go to which packs and offsets."""
    rows, taken, first_pack = [], defaultdict(int), 0
    for packs, parts in patterns:
        offset = 0
        for length, times in parts:
            rows.append((length, taken[length], first_pack, times, offset))
            taken[length] += packs * times
            offset += length * times
        first_pack += packs
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "pack", "times", "offset"), columns, strict=True))


def place(table: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence ids and offsets of the rank-th pieces of their lengths."""
    at = np.searchsorted((table["length"] << 44) + table["rank"], (length << 44) + rank, "right") - 1
    pack, slot = np.divmod(rank - table["rank"][at], table["times"][at])
    return table["pack"][at] + pack, table["offset"][at] + slot * length


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """Pieces with sequence_id and offset."""
    cut = durable(pieces(docs, tokenizer, capacity, key), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = cut.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))

    shards = max(8, -(-sum(histogram.values()) // SHARD_ROWS))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)))
    counts = dealt.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = Window.partitionBy("length", "shard").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("nth", F.row_number().over(own)).join(shifts, ["length", "shard"])

    def assign(batches):
        for batch in batches:
            sequence, offset = place(table.value, batch["length"].to_numpy(), batch["rank"].to_numpy())
            arrays = [*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "sequence_id", "offset"])

    rank = (F.col("shift") + F.col("nth") - 1).cast("long").alias("rank")
    read = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", rank)
    return read.mapInArrow(assign, f"{PIECE}, sequence_id long, offset long")
