"""Near-copies by SimHash, verified by the Jaccard similarity of word shingles; an exact prefix filter for the rest.

Each distinct set of shingles has the fingerprint of op7 of a text that has it. Fingerprints that meet by ball hashing
(simhash.meetings: all within 5 bits, and more) are verified on the whole sets, and components taken of the links. Texts of
the similarity asked for lie up to 11 bits and more apart, so what the balls don't reach is found from what they leave in
different components:

Two sets of a similarity of at least SIMILAR have a member in common among the first fifth of each, whatever one order all
members are in. Every distinct set therefore emits that prefix; sets that meet at a member, and whose sizes and places
there allow the similarity, are verified on the whole sets. No group is capped: first all that meet at a member are
verified against one of them, then all pairs that this leaves in different components. So no similar pair is lost.

The order puts the members that a sample finds common last, so that they rarely stand in a prefix. It has no part in what
is found, only in how many pairs are verified.

Defined results: words and shingles are those of simhash; wordless and null texts have the same empty set; repeated rows
and equal doc_ids each keep their row; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, flagged, forget, map_texts, marked, one_row_each
from .components import components
from .simhash import fingerprint_batch, meetings, shingle_hashes
from .substring import lists

SHINGLE_WORDS = 5
#: Least similarity of near-copies, as a fraction.
SIMILAR = (4, 5)
#: One text in so many is sampled for common shingles; common are those found COMMON times, at most MOST_COMMON of them.
SAMPLE_EVERY, COMMON, MOST_COMMON = 16, 8, 20_000
#: Parts in which pairs are verified one after the other, so that the sets that are shuffled for one go before the next.
SLICES = 4


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes in ascending order."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE_WORDS), np.uint64).view(np.int64))


def set_key(members: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(members.tobytes())).astype(np.int64))


def prefix_size(n: int) -> int:
    return n - (SIMILAR[0] * n + SIMILAR[1] - 1) // SIMILAR[1] + 1 if n else 0


def is_among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known ones, which are in ascending order."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Common shingles of a sample of distinct texts, ascending."""

    def make():
        def call(keys: list, texts: list) -> dict:
            return {"h": pa.array(np.concatenate([shingle_set(t) for t in texts]))}

        return call

    sample = marked(docs).where(F.pmod("mark", F.lit(SAMPLE_EVERY)) == 0).dropDuplicates(["mark"])
    many = map_texts(sample, make, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.array([r["h"] for r in many.orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()], np.int64))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, key, fp, n, prefix): of each document the key and size of its set, its fingerprint as a signed long, and
    the set's first members in the common order."""
    late = common_shingles(docs)

    def make():
        def call(keys: list, texts: list, marks: list) -> dict:
            out: dict = {"doc_id": keys, "mark": marks, "key": [], "fp": fingerprint_batch(texts).view(np.int64), "n": []}
            firsts = []
            sets = [shingle_set(text) for text in texts]
            commons = is_among(np.concatenate(sets), late)
            for members, common in zip(sets, np.split(commons, np.cumsum([len(x) for x in sets])[:-1]), strict=True):
                out["key"].append(set_key(members))
                out["n"].append(len(members))
                firsts.append(np.r_[members[~common], members[common]][: prefix_size(len(members))])
            owner = np.repeat(np.arange(len(firsts)), [len(x) for x in firsts])
            return out | {"prefix": lists(np.concatenate(firsts), owner, len(firsts), pa.int64())}

        return call

    return map_texts(marked(docs), make, "doc_id long, mark long, key long, fp long, n long, prefix array<long>", more=("mark",))


def possible(a: str, b: str):
    """Whether the sizes and places of two that meet at a member allow the similarity."""
    low, high = SIMILAR
    together = F.col(f"{a}.n") + F.col(f"{b}.n")
    most = F.least(F.col(f"{a}.n") - F.col(f"{a}.at"), F.col(f"{b}.n") - F.col(f"{b}.at"))
    return (low + high) * most >= low * together


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): those of the pairs whose sets are similar."""

    def make():
        def call(keys: list, texts: list) -> dict:
            sets = [shingle_set(t) for t in texts]
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            members = lists(np.concatenate(sets), owner, len(sets), pa.int64())
            return {"key": [set_key(x) for x in sets], "members": members}

        return call

    ends = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    sets = flagged(marked(docs), nodes.join(ends, "key", "left_semi"), "doc_id", "mark", "flag").where("flag")
    sets = durable(map_texts(sets, make, "key long, members array<long>").dropDuplicates(["key"]), "sets")
    low, high = SIMILAR
    left = sets.select(F.col("key").alias("u"), F.col("members").alias("a"))
    right = sets.select(F.col("key").alias("v"), F.col("members").alias("b"))
    alike = (low + high) * F.size(F.array_intersect("a", "b")) >= low * (F.size("a") + F.size("b"))
    parts = []
    for k in range(SLICES):  # every pair is in one of the slices
        some = pairs.where(F.pmod(F.xxhash64("u", "v"), F.lit(SLICES)) == k)
        parts.append(durable(some.join(left, "u").join(right, "v").where(alike).select("u", "v"), "found"))
    forget(sets)
    return reduce(DataFrame.unionByName, parts)


def still_open(posts: DataFrame, found: DataFrame) -> DataFrame:
    """The posts at members where several components of the links meet, each with the root of its own."""
    posts = posts.select("h", "key", "n", "at")
    named = posts.join(components(found).withColumnRenamed("node", "key"), "key", "left")
    named = named.select("h", "key", "n", "at", F.coalesce("root", "key").alias("root"))
    named = durable(named, "named")
    mixed = named.groupBy("h").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most")
    left = durable(named.join(mixed.select("h"), "h"), "open")
    forget(named)
    return left


def links(docs: DataFrame, made: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): verified links between distinct sets that connect all that are similar."""
    balls = durable(meetings(nodes), "balls")
    found = verified(balls, docs, nodes)
    # What meets at a member and is of one component already needs no link of its own.
    posts = made.join(nodes.select("row"), "row").select("key", "n", F.posexplode("prefix").alias("at", "h"))
    posts = posts.withColumn("many", F.count("*").over(Window.partitionBy("h"))).where("many > 1").drop("many")
    posts = still_open(posts, found)
    # Where a member comes earliest, least of the set is its own: of a text and its edited copies, that is the text.
    first = posts.groupBy("h").agg(F.min(F.struct("at", "key", "n", "root")).alias("first")).select("h", "first.*")
    met = posts.alias("a").join(first.alias("b"), "h").where("a.root != b.root").where(possible("a", "b"))
    tried = met.select(F.col("a.key").alias("u"), F.col("b.key").alias("v")).distinct()
    tried = durable(tried, "tried")
    found = found.unionByName(verified(tried, docs, nodes))
    open_posts = still_open(posts, found)
    met = open_posts.alias("a").join(open_posts.alias("b"), "h").where("a.key > b.key and a.root != b.root")
    # All that two prefixes have in common is met here: a later common member lies beyond one of the prefixes.
    last = [F.max(f"{x}.at").alias(f"{x}_at") for x in "ab"]
    sizes = [F.first(f"{x}.n").alias(f"{x}_n") for x in "ab"]
    pairs = met.groupBy(F.col("a.key").alias("u"), F.col("b.key").alias("v")).agg(F.count("*").alias("same"), *last, *sizes)
    low, high = SIMILAR
    beyond = [F.expr(f"(({low} * {x}_n + {high} - 1) div {high}) - 1") for x in "ab"]
    after = F.least(F.greatest(*beyond), F.col("a_n") - F.col("a_at") - 1, F.col("b_n") - F.col("b_at") - 1)
    rest = pairs.where((low + high) * (F.col("same") + after) >= low * (F.col("a_n") + F.col("b_n"))).select("u", "v")
    rest = durable(rest.join(tried, ["u", "v"], "left_anti"), "rest")
    found = found.unionByName(verified(rest, docs, nodes))
    for done in (balls, posts, open_posts, tried, rest):
        forget(done)
    return found


def rooted(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, node, root) of every row: the key of its set and the one that its component is named by."""
    made = durable(sketches(docs).withColumn("row", F.monotonically_increasing_id()), "copies")
    one = F.min(F.struct("row", "doc_id", "mark", "fp")).alias("one")
    nodes = durable(made.groupBy("key").agg(one).select("key", "one.*"), "nodes")
    roots = components(links(docs, made, nodes))
    named = made.select("doc_id", "mark", F.col("key").alias("node")).join(roots, "node", "left")
    named = durable(named.select("doc_id", "mark", "node", F.coalesce("root", "node").alias("root")), "rooted")
    for done in (made, nodes):
        forget(done)
    return named


def near_copies(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, key of its set and component_id, the smallest doc_id that its links reach (its own included)."""
    rows = rooted(docs)
    nodes = durable(rows.groupBy("node", "root").agg(F.min("doc_id").alias("least")), "nodes")
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "root").select("node", "component_id")
    return rows.join(named, "node").select("doc_id", F.col("node").alias("key"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the smallest doc_id, then of the smallest hash of its text; null ids last."""
    return one_row_each(docs, rooted(docs))
