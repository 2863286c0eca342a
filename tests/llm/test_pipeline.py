import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_simhash import brute_components
from tests.llm.test_substring import brute


def folder(spark, path):
    rng = random.Random(12)
    letters = {"a": "abcdeé", "b": "vwxyzd"}
    rows, labels = [], []
    for k in range(240):
        lang = "ab"[k % 2]
        words = ["".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 90))]
        if k % 6 == 0:
            words[5:5] = ["nastyword"] * 4
        if k % 10 == 3:
            words[7:7] = [f"passage{i}" for i in range(45)]
        rows.append((k, " ".join(words), lang, "s", 0))
        labels.append((k, 1, int(k % 6 == 0)))
    rows += [(k, rows[k - 300][1], "a", "s", 0) for k in range(301, 311)]
    rows += [(400, None, None, None, None), (401, "", "a", "s", 0), (402, "12 !", "a", "s", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages_do_what_they_say(spark, tmp_path):
    folder(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before
        if name != "packing":
            assert docs.columns == columns
    ids = {n: set(d) for n, d in seen.items()}
    toxic = {k for k in range(240) if k % 6 == 0}
    assert len(ids["language"] & toxic) <= 2 and len(ids["toxicity"] - ids["language"] - toxic) <= 8
    assert not ids["near_duplicates"] & {400, 401, 402} and len(ids["language"] - ids["near_duplicates"]) <= 6
    groups = brute_components([(k, r.text) for k, r in seen["near_duplicates"].items()])
    assert ids["repeats"] == {c for _, c in groups.values()}
    removed = {k: n for k, _, n, _ in brute([(k, r.text) for k, r in seen["repeats"].items()], 35)}
    assert max(removed.values()) >= 45
    for k, r in seen["packing"].items():
        assert len(r.text.split()) == len(seen["repeats"][k].text.split()) - removed[k] and r.n_chars == len(r.text)
    library, tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for r in docs.collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {k: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for k, r in seen["packing"].items()}
    assert np.all([r.offset + r.length <= 4096 for r in docs.collect()])


def test_run_and_empty_tables(spark, tmp_path):
    folder(spark, tmp_path)
    made = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(made.columns) and made.count() > 50
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_stages_with_repeated_ids_and_columns_of_any_name(spark, tmp_path):
    folder(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id < 60 or doc_id >= 400")
    wide = docs.selectExpr("*", "1 as mark", "2 as flag", "3 as kept", "4 as bucket", "5 as bits")
    twice = wide.unionByName(wide.where("doc_id < 5")).unionByName(wide.where("doc_id = 7").selectExpr("8L as doc_id", *wide.columns[1:]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, twice, str(tmp_path))
        assert made.columns == wide.columns, name
        rows = made.collect()
        assert {(r.mark, r.flag, r.kept, r.bucket, r.bits) for r in rows} == {(1, 2, 3, 4, 5)}
        if name == "near_duplicates":
            assert len({(r.doc_id, r.text) for r in rows}) == len(rows) and sum(r.doc_id == 8 for r in rows) == 1
    assert corpus_pipeline.packing_stage(spark, twice, str(tmp_path)).select("doc_id").distinct().count() == docs.count()


def test_every_stage_has_executors_give_heap_back(spark, tmp_path, monkeypatch):
    folder(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        calls = []
        monkeypatch.setattr(corpus_pipeline, "shrink", calls.append)
        stage(spark, docs, str(tmp_path))
        assert calls == [spark], name
