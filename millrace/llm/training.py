"""Bounded, reproducible training samples for the small models of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folds of crc32(doc_id); the first is held out.
FOLDS = 5


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % FOLDS == 0


def sample(docs: DataFrame, marks: DataFrame | None, target: str, most_rows: int, most_chars: int) -> list[tuple[str, object]]:
    """(text, target) of at most ``most_rows`` different documents outside the held-out fold.

    The target is a column of ``marks`` (doc_id, target), or of the documents themselves where marks is None. Documents go
    in the order of a hash of their doc_id, as long as their texts have at most ``most_chars`` characters in all; longer
    ones are passed over. A document is a (doc_id, text): repeated rows count once, with the smallest of their targets, and
    rows that share a doc_id only are each their own. Only lengths and hashes are joined and ordered; the texts of those
    chosen are then picked by a broadcast (at most ``most_rows`` rows), so no text is shuffled before that and the driver
    never holds more than these bounds.
    """
    known = docs.where(F.col("text").isNotNull() & ~held_out()).withColumn("mark", F.xxhash64("text"))
    sized = known.select("doc_id", "mark", F.char_length("text").alias("n"), *([] if marks is not None else [target]))
    if marks is not None:
        sized = sized.join(marks.select("doc_id", target), "doc_id")
    sized = sized.where(F.col(target).isNotNull()).groupBy("doc_id", "mark", "n").agg(F.min(target).alias(target))
    chosen, room = {}, most_chars
    for doc_id, mark, n, value in sized.orderBy(F.xxhash64("doc_id"), "doc_id", "n", "mark").limit(most_rows).collect():
        if n <= room:
            chosen[doc_id, mark] = value
            room -= n
    if not chosen:
        return []
    few = docs.sparkSession.createDataFrame(sorted(chosen), "doc_id long, mark long")
    taken = known.join(F.broadcast(few), ["doc_id", "mark"]).groupBy("doc_id", "mark").agg(F.first("text").alias("text"))
    return [(text, chosen[doc_id, mark]) for doc_id, mark, text in sorted(tuple(r) for r in taken.collect())]
