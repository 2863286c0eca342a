"""Quality rules: base statistics, then distribution divergence from language references.

Every document's histogram of character classes, and its histogram of common words (with bins for other words and for words
without a letter), are compared with those of each
language by Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). A document is kept if it doesn't
fail the base rules and, for some language, both distances are within their limits. Guards: the class histogram is judged
from MIN_CHARS characters, the word histogram from MIN_WORDS words; a shorter text isn't judged by that one.

The references are gathered from the documents themselves by language, over all documents: summed class histograms, and
counts of the language's most frequent words.

Defined results: a null or wordless text has no words, fails the base rule on length and is not kept; a table whose lang is
null throughout has one reference of that null language; repeated rows each count.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, map_texts
from .substring import split_words

MIN_WORDS_KEPT = 50
MIN_CHARS = 500
MIN_WORDS = 100
#: Common words of a reference.
COMMON = 40
MAX_CLASS_DISTANCE = 0.29
MAX_WORD_DISTANCE = 0.46
CACHE_WORDS = 600_000
#: Character classes in this order: lower case, upper case, other letters, digits, spaces, line ends, and punctuation in
#: three kinds: of sentences, of pairs and quotes, any other.
CLASSES = 9
SYMBOLS = "[#*$%&|<>]"


def class_table() -> np.ndarray:
    """The class of each code point."""
    import unicodedata

    table = np.full(0x110000, 8, np.uint8)
    kind = {"Ll": 0, "Lu": 1, "Lt": 1, "Lm": 2, "Lo": 2, "Nd": 3, "Nl": 3, "No": 3, "Zs": 4, "Mn": 2, "Mc": 2}
    for point in range(0x20000):
        table[point] = kind.get(unicodedata.category(chr(point)), 8)
    table[0x20000:0x323B0] = 2
    table[[9, 11, 12]], table[[10, 13]] = 4, 5
    table[[ord(c) for c in ".,;:!?"]] = 6
    table[[ord(c) for c in "()[]{}\"'«»“”‘’"]] = 7
    return table


class Measures:
    """Base statistics and class histograms of batches of texts."""

    def __init__(self):
        self.classes = class_table()
        self.symbol = np.zeros(128, bool)
        self.symbol[[ord(c) for c in SYMBOLS[1:-1]]] = True
        self.seen: defaultdict[bytes, int] = defaultdict(count().__next__)

    def call(self, keys: list, texts: list, langs: list) -> dict:
        if len(self.seen) > CACHE_WORDS:
            self.seen = defaultdict(count().__next__)
        out = defaultdict(list)
        for text in texts:
            text = text or ""
            words = split_words(text)
            codes = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            n, repeated = len(words), repeat_words(codes)
            found = np.bincount(self.classes[points], minlength=CLASSES)
            space = int(((points == 32) | (points - 9 < 5)).sum())
            ascii_points = points[points < 128]
            out["n_words"].append(n)
            out["word_chars"].append(len(points) - space)
            out["n_symbols"].append(int(self.symbol[ascii_points].sum()))
            out["n_dup_lines"].append(dup_lines(text))
            out["n_repeat_words"].append(repeated)
            out["base_failed"].append(n < MIN_WORDS_KEPT or 100 * repeated > 50 * n)
            out["classes"].append(found.tolist())
        return {"doc_id": keys, "lang": langs, **out}


def repeat_words(codes: np.ndarray) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(codes) - 2
    if n < 2:
        return 0
    _, local = np.unique(codes, return_inverse=True)
    width = int(local.max()) + 1
    if width < 1 << 20:
        window = (local[:n] * width + local[1 : n + 1]) * width + local[2:]
    else:  # three numbers don't fit one
        _, pair = np.unique(local[:-1] * width + local[1:], return_inverse=True)
        window = pair[:-1] * width + local[2:]
    _, which, many = np.unique(window, return_inverse=True, return_counts=True)
    edge = np.zeros(n + 3, np.int64)
    at = np.flatnonzero(many[which] > 1)
    edge[at] += 1
    edge[at + 3] -= 1
    return int((np.cumsum(edge)[: n + 2] > 0).sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    many = Counter(lines)
    if len(many) == len(lines):
        return 0
    return sum(n - 1 for line, n in many.items() if n > 1 and line.strip(" \t\n\r\x0b\x0c"))


MEASURED = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, classes array<long>"
)


def stripped(text: str | None) -> list[bytes]:
    """Lower-case words without the ASCII punctuation and digits at their ends; empty where nothing is left."""
    return [w.strip(EDGES) for w in split_words(text.lower() if text else "")]


EDGES = b"!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"


def references(docs: DataFrame, common: int = COMMON) -> dict[str | None, dict]:
    """Class histogram and common words of each language, from one pass over all documents.

    Each task adds up its batches by language and word before anything is shuffled. Of the words, only the ``common`` first
    of each language come to the driver; every language makes a reference.
    """

    def make():
        table = class_table()

        def call(keys: list, texts: list, langs: list) -> dict:
            by: dict = defaultdict(Counter)
            for text, lang in zip(texts, langs, strict=True):
                if text:
                    by[lang].update(stripped(text))
                    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                    found = np.bincount(table[points], minlength=CLASSES)
                    by[lang].update({k: n for k, n in enumerate(found.tolist()) if n})
            rows = [(lang, w, None, n) if isinstance(w, int) else (lang, None, w.decode(), n) for lang, c in by.items() for w, n in c.items()]
            return {name: [r[k] for r in rows] for k, name in enumerate(("lang", "class", "word", "n"))}

        return call

    counted = map_texts(docs, make, "lang string, class int, word string, n long", more=("lang",))
    counted = durable(counted.groupBy("lang", "class", "word").agg(F.sum("n").alias("n")), "counted")
    classes, words, bare, total = defaultdict(lambda: [0] * CLASSES), defaultdict(dict), defaultdict(int), {}
    for r in counted.where("class is not null").collect():
        classes[r["lang"]][r["class"]] = r["n"]
    worded = counted.where("class is null")
    for r in worded.groupBy("lang").agg(F.sum(F.expr("if(word = '', n, 0)")).alias("bare"), F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").collect():
        bare[r["lang"]], total[r["lang"]] = r["bare"], r["n"]
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = worded.where("word != ''").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= common)
    for r in top.select("lang", "word", "n").collect():
        words[r["lang"]][r["word"]] = r["n"]
    made = {}
    for lang, n in total.items():
        own = dict(sorted(words[lang].items()))
        made[lang] = {"classes": classes[lang], "words": own, "bare": bare[lang], "rest": n - bare[lang] - sum(own.values())}
    return made


#: References that documents are compared with at once.
BLOCK = 64


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of histograms along the last axis, in base 2; an empty histogram is at distance 1."""
    sp, sq = p.sum(-1, keepdims=True), q.sum(-1, keepdims=True)
    p, q = p / np.maximum(sp, 1), q / np.maximum(sq, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    out = np.sqrt(np.clip((left + right) / 2, 0, 1))
    return np.where((sp[..., 0] == 0) | (sq[..., 0] == 0), 1.0, out)


class Block:
    """Some references, as arrays."""

    def __init__(self, refs: list[dict]):
        self.classes = np.array([r["classes"] for r in refs], np.float64).reshape(-1, CLASSES)
        width = max((len(r["words"]) for r in refs), default=0) + 2
        self.shares = np.zeros((len(refs), width))
        self.places: defaultdict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, r in enumerate(refs):
            for i, (word, n) in enumerate(r["words"].items()):
                self.places[word.encode()].append((k, i))
                self.shares[k, i] = n
            self.shares[k, -2:] = r["bare"], r["rest"]

    def word_distances(self, many: Counter) -> np.ndarray:
        """Distance of a text's words from each reference."""
        seen = np.zeros(self.shares.shape)
        for w in many.keys() & self.places.keys():
            for k, i in self.places[w]:
                seen[k, i] = many[w]
        seen[:, -2] = many[b""]
        seen[:, -1] = sum(many.values()) - many[b""] - seen[:, :-2].sum(1)
        return js_distance(seen, self.shares)


def judge(docs: DataFrame, known: dict[str | None, dict]) -> DataFrame:
    """(MEASURED, class_distance, word_distance, kept) with distances to the nearest reference language."""

    def make():
        own = Measures()
        refs = list(known.values())
        blocks = [Block(refs[i : i + BLOCK]) for i in range(0, len(refs), BLOCK)]

        def call(keys: list, texts: list, langs: list) -> dict:
            out = own.call(keys, texts, langs)
            found = np.array(out["classes"], np.float64).reshape(-1, CLASSES)
            short, few = found.sum(1) < MIN_CHARS, np.array(out["n_words"]) < MIN_WORDS
            near, some_ok = np.ones((2, len(keys))), np.zeros(len(keys), bool)
            counts = [Counter(stripped(text)) for text in texts] if blocks else []
            pick = np.arange(len(keys))
            if not blocks:
                some_ok = short & few
            for k, block in enumerate(blocks):
                by_class = js_distance(found[:, None], block.classes[None])
                words = np.array([block.word_distances(many) for many in counts])
                class_ok = (by_class <= MAX_CLASS_DISTANCE) | short[:, None]
                some_ok |= (class_ok & ((words <= MAX_WORD_DISTANCE) | few[:, None])).any(1)
                at = np.argmin(by_class + words, axis=1)
                both = np.array([by_class[pick, at], words[pick, at]])
                near = np.where(both.sum(0) < near.sum(0), both, near) if k else both
            kept = some_ok & ~np.array(out["base_failed"], bool)
            return out | {"class_distance": near[0], "word_distance": near[1], "kept": kept}

        return call

    schema = f"{MEASURED}, class_distance double, word_distance double, kept boolean"
    return map_texts(docs, make, schema, more=("lang",))


def assess(docs: DataFrame) -> DataFrame:
    """Judge documents against the references that they make themselves."""
    return judge(docs, references(docs)).drop("classes", "lang")
