import hashlib
import random

import public_tokenizers
import sentencepiece

from millrace.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(3)
    made = ["", None, " ", " " * 100, "a" * 5000, "=" * 300 + "\n" * 77, "▁▁x ▁", "<s></s><0x41>\x00", "日本語 😀"]
    made += ["".join(rng.choice(" ab\nteß語▁.-=😀iohn") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    return made + made[:9]


def test_ids_and_text_as_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    table = pieces.Pieces(MODEL)
    encoder = pieces.Encoder(table, cache_words=50)
    for text in texts():
        ids = library.encode(text or "")
        assert encoder.encode([text]) == [ids]
        assert table.decode(ids) == library.decode(ids)
    rng = random.Random(4)
    for _ in range(500):
        ids = [rng.choice((rng.randrange(3, 259), rng.randrange(259, 32000))) for _ in range(rng.randint(0, 9))]
        assert table.decode(ids) == library.decode(ids)


def test_digests(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: tuple(r)[1:] for r in pieces.digests(docs, MODEL).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for k, t in rows:
        ids = library.encode(t or "")
        assert got[k] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert pieces.encode_decode(docs.limit(0), MODEL).count() == 0
