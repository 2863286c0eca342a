"""Connected components of a link table by alternating star contractions, entirely in distributed tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

SCHEMA = "u long, v long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition to a spanning forest of stars: (node, smallest node of its tree)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in parent]
    pairs = [(x, r) for x, r in pairs if x != r]
    for i in range(0, len(pairs), 65536):
        part = pairs[i : i + 65536]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in part], pa.int64()) for k in (0, 1)], ["u", "v"])


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One contraction. Links are (u, v) with u > v.

    Large: every node's larger neighbours are linked to its smallest neighbour. Small: every node and its smaller
    neighbours are linked to the smallest of them. Minima are aggregated before the shuffle, and the join back to the
    links is one that adaptive execution may split where a node has very many.
    """
    if large:
        sides = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = links
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = sides.join(least, "u")
    if large:
        made = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return made.where("u > v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (u, v) that isn't the smallest of its component.

    Null ends and loops are ignored. Each round's links are a written table, so a lost executor repeats one round at most.
    """
    ordered = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    ordered = ordered.where("u is not null and v is not null and u > v")
    now = durable(ordered.mapInArrow(_forest, SCHEMA).distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
        now = durable(_stars(_stars(now, True), False), "links")
    raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
