"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2 bits have a common neighbour within 1 bit of both. Every distinct fingerprint
therefore emits itself and its 64 one-bit variants, the variants are shuffled, and fingerprints that meet at one are
deduplicated and verified. At most 65 fingerprints can meet at a variant, whatever the data, so no group grows with the
input; exact copies share a fingerprint and are one node. ``meetings`` hashes balls around both halves of a fingerprint for
links that are wider and verified elsewhere (copies).

Defined results: a null or wordless text has fingerprint zero, which links like any other; fewer than three words make
one shingle of the whole sequence; repeated rows and equal doc_ids each keep their row; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_texts, marked, may_have, one_row_each
from .components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Shingle hashes whose bits are counted at once.
BLOCK = 1 << 17
#: Fingerprints whose variants one task makes.
NODES_OF_TASK = 40_000


def shingle_hashes(text: str | None, size: int = SHINGLE_WORDS, seed: int = SEED) -> list[int]:
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z and only ASCII white space
    if not words:
        return []
    joined, size = b" ".join(words), min(size, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=False)]


def fingerprint_batch(texts: list[str | None], size: int = SHINGLE_WORDS) -> np.ndarray:
    """One unsigned fingerprint for each text: a bit is 1 if over half its shingle hashes have it."""
    hashes, sizes = [], []
    ones = np.zeros((len(texts), 64), np.int64)

    def tally(first: int) -> None:
        h = np.array(hashes, np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        n = np.array(sizes)
        full = np.flatnonzero(n)
        if len(full):
            starts = (np.cumsum(n) - n)[full]
            ones[first + full] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        hashes.clear()
        sizes.clear()

    totals, first = np.zeros(len(texts), np.int64), 0
    for i, text in enumerate(texts):
        own = shingle_hashes(text, size)
        totals[i] = len(own)
        for a in range(0, len(own), BLOCK):
            part = own[a : a + BLOCK]
            hashes += part
            sizes.append(len(part))
            if len(hashes) >= BLOCK:
                tally(first)
                first = i
                if a + BLOCK >= len(own):
                    first = i + 1
        if not own:
            sizes.append(0)
    if sizes:
        tally(first)
    set_bits = (2 * ones > totals[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, key: str = "doc_id", size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, mark, fp): the fingerprint's 64 bits as a signed long, mark a hash of the text."""

    def make():
        return lambda keys, texts, marks: {"doc_id": keys, "mark": marks, "fp": fingerprint_batch(texts, size).view(np.int64)}

    return map_texts(marked(docs, key), make, "doc_id long, mark long, fp long", more=("mark",))


def links(prints: DataFrame) -> DataFrame:
    """(u, v): verified links between distinct fingerprints that connect all within MAX_BITS bits of each other."""
    masks = F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)])
    variants = F.concat(F.array("fp"), F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m)))
    distinct = durable(prints.select("fp").where("fp is not null").distinct(), "distinct")
    met = (
        distinct.repartition(max(1, -(-distinct.count() // NODES_OF_TASK)))  # by count: few bytes become 65 times as many
        .select("fp", F.explode(variants).alias("variant"))
        .groupBy("variant")
        .agg(F.collect_list("fp").alias("fps"))
        .where("size(fps) > 1")
    )
    # All that meet at a variant are within MAX_BITS of each other: links to the smallest connect them.
    pairs = met.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where("u != v").distinct()
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)


def meetings(prints: DataFrame) -> DataFrame:
    """(u, v): pairs of keys of (key, fp), fp not null, to be verified: those that meet at a variant, with the least of them.

    Variants are those within 1 bit of either half, so every two fingerprints within 2 * MAX_BITS + 1 bits meet. Any number
    can meet at one (the other half is free): hence the least key stands for them, and a pair that it parts isn't among the
    result.
    """
    low = F.lit((1 << 32) - 1)
    masks = F.array(*[F.lit(1 << b).cast("long") for b in range(32)])
    halves = F.array(F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32)))
    variants = F.concat(F.array("half"), F.transform(masks, lambda m: F.col("half").bitwiseXOR(m)))
    dealt = prints.select("key", "fp").repartition(max(1, -(-prints.count() // NODES_OF_TASK)))  # as in links
    posts = dealt.select("key", F.explode(halves).alias("half")).select("key", F.explode(variants).alias("variant"))
    ends = posts.groupBy("variant").agg(F.min("key").alias("v"), F.max("key").alias("most"))
    shared = durable(ends.where("v != most").select("variant", "v"), "shared")
    return may_have(posts, shared, "variant").join(shared, "variant").where("key != v").select(F.col("key").alias("u"), "v").distinct()


def rooted(docs: DataFrame, key: str = "doc_id", size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, mark, node, root) of every row: its fingerprint and the one that its component is named by."""
    prints = durable(fingerprints(docs, key, size), "prints")
    roots = components(links(prints))
    named = prints.withColumnRenamed("fp", "node").join(roots, "node", "left")
    return named.select("doc_id", "mark", "node", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: doc_id, fp and component_id, the smallest doc_id that its links reach (its own included)."""
    rows = durable(rooted(docs, key), "rooted")
    nodes = rows.groupBy("node", "root").agg(F.min("doc_id").alias("first"))
    nodes = durable(nodes, "nodes")
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = nodes.join(least, "root").select("node", "component_id")
    return rows.join(named, "node").select("doc_id", F.col("node").alias("fp"), "component_id")


def digests(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of each component: that of the smallest doc_id, then of the smallest hash of its text; null ids last."""
    return one_row_each(docs, durable(rooted(docs, key), "rooted"), key)
