import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from millrace.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_are_tokenised_as_whole_texts_are():
    rng = random.Random(5)
    made = ["", None, " \n", "It's <|endoftext|>x a<|startoftext|>", "é́ ́x \x1c\x85\xa0b", "ΣΑΣ Σ İ", "A.B, c.., »., é., x'S. ². <|ENDOFTEXT|>", "It'S a.,b ،. É.́"]
    made += ["".join(rng.choice(" \n\t ab'st7é语.-😀ΣÉ́") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    made += ["<| C", "C <|", "Été <|startoftext|>Ab ABC.", "<|endoftext|> HELLO World"]
    parts = ["<|", "|>", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "A", "Ab", "hELLO", "ÉTÉ", "ß", "ﬁ", "ª", "'S", "'s", "9", ".", ",", " ", "\t", "\n", "\x0b", "\xa0", "Ǆ", "İ", "Σ", "中"]
    made += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    library, own = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    for text, ids in zip(made, own.encode(made)):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids


def check_packs(rows, capacity):
    packs, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        packs[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for parts in packs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return packs, docs


def test_pieces_cover_documents_and_packs_are_full(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["one", "two", "Three's"]) for _ in range(int(rng.expovariate(1 / 60))))) for k in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 1000)]
    docs = spark.createDataFrame([(k, t, 9) for k, t in rows], "doc_id long, text string, length int")
    got = packing.pack(docs, PATH, 128).collect()
    packs, pieces = check_packs(got, 128)
    library, crc = Tokenizer.from_file(PATH), {(r.doc_id, r.start): r.ids_crc32 for r in got}
    for k, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for start, length, total in sorted(pieces[k]):
            assert start == at and total == len(ids)
            assert crc[k, start] == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    total = sum(r.length for r in got)
    assert total / (128 * len(packs)) > 0.97
    assert sorted(packs) == list(range(len(packs)))
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_repeated_rows_and_one_common_length(spark):
    docs = spark.createDataFrame([(k % 3, "a b") for k in range(300)], "doc_id long, text string")
    got = packing.pack(docs, PATH, 10).collect()
    assert len(got) == 300 and len(check_packs(got, 10)[0]) == 100


def test_plan_places_every_piece():
    rng = random.Random(7)
    histogram = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(40)} | {1: 10_000}
    table = packing.places(packing.plan(histogram, 64))
    used = defaultdict(int)
    for length, n in histogram.items():
        sequence, offset = packing.place(table, np.full(n, length), np.arange(n))
        assert len(set(zip(sequence.tolist(), offset.tolist()))) == n
        for s in sequence.tolist():
            used[s] += length
    assert max(used.values()) <= 64
