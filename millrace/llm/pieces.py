"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Words (a run of spaces with what follows it) are independent in a vocabulary in which no piece has a space after
another character, so each distinct word of a batch is encoded once. All words lie in one flat symbol array; each round
finds the smallest pair rank of every word (a segmented minimum), merges the leftmost occurrences of that pair that don't
overlap, recomputes the ranks beside the merges and drops words in which no pair remains.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty text; white space,
repeated rows and texts of any length keep every character; characters without a piece fall back to byte pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

NONE = np.int32(2**31 - 1)
#: Distinct words that a task remembers before it starts afresh.
CACHE_WORDS = 600_000


class Merges:
    """Pairs of symbols with ranks, and the rounds that merge them."""

    def __init__(self, pairs: dict[tuple[int, int], int], made: list[int], symbols: int):
        """``pairs``: (left, right) symbol to rank; ``made``: the symbol that a rank's pair becomes; symbols are below
        ``symbols``."""
        self.of_rank = np.array(made, np.int32)
        self.width = np.int64(symbols)
        rank_of = {s: r for r, s in enumerate(made)}
        self.prone = np.zeros(len(made) + 1, bool)
        for pair, r in pairs.items():
            for x in pair:
                if rank_of.get(x, -1) > r:  # merging x makes a pair that goes before x's other occurrences
                    self.prone[rank_of[x]] = True
        keys = np.array([a * int(self.width) + b for a, b in pairs], np.int64)
        self._table(keys, np.array(list(pairs.values()), np.int32))

    def _table(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """An open hash table of pairs."""
        self.bits = max(8, int(np.ceil(np.log2(4 * len(keys) + 1))))
        size = 1 << self.bits
        self.slot_key, self.slot_rank, self.probes = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), 1
        left, at = np.arange(len(keys)), self._hash(keys)
        while len(left):
            free = self.slot_key[at] < 0
            self.slot_key[at[free]] = keys[left[free]]  # of several the last stays
            won = self.slot_key[at] == keys[left]
            self.slot_rank[at[won]] = ranks[left[won]]
            left, at = left[~won], (at[~won] + 1) & (size - 1)
            self.probes += bool(len(left))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; NONE where they don't merge."""
        out = np.full(len(left), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[todo].astype(np.int64) * self.width + right[todo]
        at = self._hash(keys)
        for _ in range(self.probes):
            found = self.slot_key[at]
            hit = found == keys
            out[todo[hit]] = self.slot_rank[at[hit]]
            more = ~hit & (found >= 0)
            if not more.any():
                break
            todo, keys, at = todo[more], keys[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out

    def merged(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of all words, which stand in order, until no pair remains. Negative symbols never merge."""
        pair = np.full(len(sym), NONE, np.int32)
        if len(sym) > 1:
            same = np.flatnonzero(word[1:] == word[:-1])
            pair[same] = self.ranks(sym[same], sym[same + 1])
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(sym)])
            least = np.repeat(np.minimum.reduceat(pair, first), size)
            if (over := least == NONE).any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, pair, least = sym[~over], word[~over], pair[~over], least[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(pair == least)
            start = np.r_[True, at[1:] != at[:-1] + 1]  # of a run such as aaaa
            step = np.arange(len(at))
            keep = (step - np.maximum.accumulate(np.where(start, step, 0))) % 2 == 0
            if (prone := self.prone[pair[at]]).any():
                keep &= ~prone | np.r_[True, word[at[1:]] != word[at[:-1]]]
            at = at[keep]
            sym[at] = self.of_rank[pair[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            at -= np.arange(len(at))
            sym, word, pair = sym[stay], word[stay], pair[stay]
            near = np.concatenate([at, at[at > 0] - 1])
            last = np.r_[word[1:] != word[:-1], True]
            pair[near[last[near]]] = NONE
            near = near[~last[near]]
            pair[near] = self.ranks(sym[near], sym[near + 1])
        if not done_sym:
            return sym, word
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]


class Pieces(Merges):
    """A BPE vocabulary with byte fallback, as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        byte = [i for i in range(n) if sp.is_byte(i)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if len(byte) != 256 or any(sp.is_unused(i) for i in plain):
            raise ValueError("a BPE model with byte fallback and without unused pieces is needed")
        if any(re.search("[^▁]▁", names[i]) for i in plain):
            raise ValueError("pieces that reach over a word's start are not supported")
        self.unk = sp.unk_id()
        self.byte_ids = np.array(sorted(byte, key=lambda i: int(names[i][3:5], 16)), np.int32)
        order = sorted(plain, key=lambda i: -sp.get_score(i))
        ids = {names[i]: i for i in plain}
        # Pieces of spaces alone: where they share the least score they merge last, the leftmost pair first.
        blank = [i for i in order if len(names[i]) > 1 and not names[i].strip("▁")]
        self.blanks = {}
        if len({sp.get_score(i) for i in blank}) < len(blank):
            others = [i for i in plain if len(names[i]) > 1 and i not in set(blank)]
            least = {sp.get_score(i) for i in blank}
            if len(least) > 1 or any("▁▁" in names[i] or sp.get_score(i) <= min(least) for i in others):
                raise ValueError("this order of pieces of spaces is not supported")
            self.blanks = {len(names[i]): i for i in [*blank, ids["▁"]]}
        merged = [i for i in order if len(names[i]) > 1 and not (self.blanks and i in set(blank))]
        if len({sp.get_score(i) for i in merged}) < len(merged):
            raise ValueError("pieces with equal scores are not supported")
        for c in sorted({c for i in plain for c in names[i]} - ids.keys()):
            ids[c] = n + len(ids)  # a character that only longer pieces have
        self.extra = {v: ord(k) for k, v in ids.items() if v >= n}
        self.first_extra = n
        rank = {names[i]: r for r, i in enumerate(merged)}
        self.symbol = np.full(0x110000, -1, np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.symbol[ord(" ")] = self.symbol[ord("▁")]
        pairs = {}
        for piece, r in rank.items():
            for k in range(1, len(piece)):
                if piece[:k] in ids and piece[k:] in ids:
                    pairs[ids[piece[:k]], ids[piece[k:]]] = r
        super().__init__(pairs, merged, max(n, *ids.values()) + 1)
        self.bytes = [b""] * n
        for i in plain:
            self.bytes[i] = names[i].replace("▁", " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        self.bytes[self.unk] = " ⁇ ".encode()
        self.decimal = [str(i) for i in range(n)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has. Words hold spaces as such."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        sym = self.symbol[points]
        sym = np.where(sym < 0, -2 - points, sym)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        sym, word = self.merged(sym, word)
        if self.blanks:
            sym, word = self._blank_runs(sym, word)
        return self._fall_back(sym, word, len(words))

    def _blank_runs(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the single spaces that are left at the words' starts."""
        one = sym == self.blanks[1]
        second = np.flatnonzero(one[1:] & one[:-1] & (word[1:] == word[:-1])) + 1
        if not len(second):
            return sym, word
        start = second[np.r_[True, second[1:] != second[:-1] + 1]] - 1
        size = np.diff(np.searchsorted(second, np.r_[start, len(sym)])) + 1
        made = {n: np.array([self.blanks[k] for k in self._leftmost(n)], np.int32) for n in np.unique(size).tolist()}
        stay = np.ones(len(sym), bool)
        for a, n in zip(start.tolist(), size.tolist(), strict=True):
            new = made[n]
            sym[a : a + len(new)] = new
            stay[a + len(new) : a + n] = False
        return sym[stay], word[stay]

    def _leftmost(self, n: int) -> list[int]:
        """Lengths of the pieces of n spaces, as the leftmost pair merges each time."""
        done, now, left = [], 1, n - 1
        while True:
            if done and done[-1] + now in self.blanks:
                now += done.pop()
            elif left and now + 1 in self.blanks:
                now, left = now + 1, left - 1
            else:
                done.append(now)
                if not left:
                    return done
                now, left = 1, left - 1

    def _fall_back(self, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        for i in np.unique(sym[sym >= self.first_extra]):
            sym[sym == i] = -2 - self.extra[int(i)]
        width = np.ones(len(sym), np.int64)
        bare = np.flatnonzero(sym < 0)
        if len(bare):
            points, which = np.unique(-2 - sym[bare], return_inverse=True)
            coded = [chr(p).encode("utf-8", "surrogatepass") for p in points]
            width[bare] = np.array([len(c) for c in coded])[which]
            flat = self.byte_ids[np.frombuffer(b"".join(coded[k] for k in which), np.uint8)]
            mask = np.repeat(sym < 0, width)
            sym = np.repeat(sym, width)
            sym[mask] = flat
        return sym, np.bincount(word, weights=width, minlength=n).astype(np.int64)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; one space at the start goes, as encoding adds it."""
        raw = b"".join(map(self.bytes.__getitem__, ids))
        if ids and raw[:1] == b" " and ids[0] != self.byte_ids[32]:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "bytewise")


def _bytewise(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


class Encoder:
    """Encodes whole texts, remembering a bounded number of distinct words."""

    WORD = re.compile(" *[^ ]+| +")

    def __init__(self, pieces: Pieces, cache_words: int = CACHE_WORDS):
        import codecs

        codecs.register_error("bytewise", _bytewise)
        self.pieces, self.cache_words = pieces, cache_words
        self._reset()

    def _reset(self) -> None:
        self.seen: defaultdict[str, int] = defaultdict(count().__next__)
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        if len(self.seen) > self.cache_words:
            self._reset()
        known = len(self.seen)
        codes, words = [], [0]
        for text in texts:
            if text:
                codes += map(self.seen.__getitem__, self.WORD.findall(" " + text.replace("▁", " ")))
            words.append(len(codes))
        if len(self.seen) > known:
            fresh = list(self.seen)[known:]
            ids, sizes = self.pieces.encode_words(fresh)
            self.flat = np.concatenate([self.flat, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        code = np.array(codes, np.int64)
        size = self.ends[code + 1] - self.ends[code]
        upto = np.r_[0, np.cumsum(size)]
        ids = self.flat[np.repeat(self.ends[code] - upto[:-1], size) + np.arange(upto[-1])]
        cut = upto[words]
        return [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def encode_decode(docs: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """Per document: its key as doc_id, ids (array of int) and decoded (text decoded from these ids)."""

    def make():
        encoder = Encoder(Pieces(model))

        def call(keys: list, texts: list) -> dict:
            ids = encoder.encode(texts)
            return {"doc_id": keys, "ids": ids, "decoded": [encoder.pieces.decode(x) for x in ids]}

        return call

    return map_texts(docs, make, "doc_id long, ids array<int>, decoded string", key)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of the decimal ids joined by commas and of the decoded text."""

    def make():
        encoder = Encoder(Pieces(model))
        decimal = encoder.pieces.decimal

        def call(keys: list, texts: list) -> dict:
            ids = encoder.encode(texts)
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            return {
                "doc_id": keys,
                "n_tokens": [len(x) for x in ids],
                "ids_sha256": [sha(",".join(map(decimal.__getitem__, x))) for x in ids],
                "decoded_sha256": [sha(encoder.pieces.decode(x)) for x in ids],
            }

        return call

    return map_texts(docs, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
