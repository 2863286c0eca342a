"""The corpus pipeline: documents through toxicity, language, near-duplicate and repeat filters into packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of ``documents``. run()
writes each stage's rows to the shared folder and reads them back as the next one's docs.

Nulls and odd rows: toxicity judges a null or empty text as one without n-grams, which stays unless toxic labels prevail;
language rejects null texts and those without a letter; near_duplicates takes all wordless texts for copies of each other,
and keeps one row of each group also where rows share a doc_id or have none; repeats leaves null and short texts as they
are; packing gives a null or empty text one piece of the closing id. Other columns of docs pass through all stages but the
last, whatever their names; empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import copies, langid, packing, substring, toxicity
from millrace.llm.common import durable, shrink, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict as toxic."""
    shrink(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    shrink(spark)
    return langid.keep_identified(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates: candidates by SimHash, verified on 5-word
    shingles at a similarity of 0.8, and by an exact filter what SimHash doesn't reach."""
    shrink(spark)
    return copies.one_of_each(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that occur elsewhere, too. n_chars follows the text."""
    from pyspark.sql import functions as F

    shrink(spark)
    return substring.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents."""
    shrink(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeats_stage),
    ("packing", packing_stage),
]

#: Tokenisers and trained models have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
