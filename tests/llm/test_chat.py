import hashlib

from millrace.llm import chat

ROWS = [
    (1, 2, "assistant", "b\\ </s> <\\/s> [\\\\INST] <<s>"),
    (1, 0, "system", None),
    (1, 1, "user", "a [TURN] [/INST]"),
    (1, 3, "assistant", ""),
    (1, 3, "assistant", ""),
    (1, 5, "assistant", "é😀 </s>"),
    (1, 4, None, "x\\"),
    (2, None, "[INST] user", "only\n</s>"),
    (None, 1, "assistant", " </s> "),
    (4, 1, "user", ""),
    (4, 1, "user", "[TURN]"),
]
KEYS = "conv_id long, turn long, role string, text string, formatted int"


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(own), sha(said), len(loss), sha(loss))
    return out


def test_reads_back_what_was_said(spark):
    turns = spark.createDataFrame([(*r, 1) for r in ROWS], KEYS)
    rows = chat.digests(chat.with_probe(turns)).collect()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows}
    assert got == brute(ROWS + chat.PROBE)


def test_merges_adjacent_turns_of_a_role(spark):
    turns = spark.createDataFrame([(1, 1, "user", "a", 0), (1, 2, "user", "b", 0), (1, 3, "assistant", "c", 0)], KEYS)
    row = chat.format_conversations(turns).first()
    assert row.formatted == "<s>[INST] user [/INST] a [TURN] b </s>[INST] assistant [/INST] c </s>"
    assert [row.formatted[s.start : s.stop] for s in row.loss_spans] == ["c"]
    assert chat.digests(turns.limit(0)).count() == 0


def test_ties_keep_the_order_of_what_was_said(spark):
    said = ["a</s>", "a<0", "a<[", "a<", "a[INST]"]
    turns = spark.createDataFrame([(1, 0, "user", t) for t in reversed(said)] * 2, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(turns)
    got = made.select(chat.parse(made["formatted"]).alias("t")).first()["t"]
    assert [x["text"] for x in got] == sorted(said * 2)


def test_a_very_long_text_comes_back(spark):
    text = "</s> [INST] word " * 100_000
    turns = spark.createDataFrame([(1, 0, "assistant", text), (1, 1, "user", None)], "conv_id long, turn long, role string, text string")
    row = chat.digests(turns).first()
    assert row["n_turns"] == 2 and row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
