"""Shared memory with a time to live, as a table of writes (ns, key, value, written_at, ttl_s, persistent, seq).

An entry lives from its write, in [written_at, written_at + ttl); 0 is for ever, a negative ttl is expired at once. The last
write of a key wins, its lifetime included; a write of null is a deletion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WRITES = "ns string, key string, value string, written_at timestamp, ttl_s long, persistent boolean, seq long"


def expires(written: Column, ttl: Column) -> Column:
    return F.when(ttl != 0, F.timestamp_micros(F.unix_micros(written) + ttl * 1_000_000))


def live(at: Column) -> Column:
    return F.col("value").isNotNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > at))


def writes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("expires_at", expires(F.col("written_at"), F.col("ttl_s")))


def latest(log: DataFrame) -> DataFrame:
    """The last write of every key, expired or not."""
    row = F.max_by(F.struct("value", "written_at", "expires_at", "persistent", "seq"), F.struct("written_at", "seq"))
    return log.groupBy("ns", "key").agg(row.alias("w")).select("ns", "key", "w.*")


def get(reads: DataFrame, log: DataFrame, key: str, at: str = "ts", order: str = "event_id") -> DataFrame:
    """Each read with the value of its key, or null where there is none or it has expired: an as-of lookup.

    Reads and writes meet in one sorted window, so a key's history is passed once however many reads it has. A write at a
    read's very time counts if its seq is smaller than the read's ``order``.
    """
    fields = ["value", "expires_at"]
    put = log.select(F.col("key").alias("__k"), F.col("written_at").alias("__t"), F.col("seq").alias("__s"), F.struct(*fields).alias("__w"))
    ask = reads.select(F.col(key).cast("string").alias("__k"), F.col(at).alias("__t"), F.col(order).alias("__s"), F.struct(*reads.columns).alias("__r"))
    both = put.unionByName(ask, allowMissingColumns=True)
    before = Window.partitionBy("__k").orderBy("__t", "__s").rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("__w", F.last("__w", ignorenulls=True).over(before)).where("__r is not null")
    ok = F.col("__w.value").isNotNull() & (F.col("__w.expires_at").isNull() | (F.col("__w.expires_at") > F.col("__t")))
    return seen.select("__r.*", F.when(ok, F.col("__w.value")).alias("memory_value"))


def has(reads: DataFrame, log: DataFrame, key: str) -> DataFrame:
    return get(reads, log, key).where("memory_value is not null").drop("memory_value")


def snapshot(log: DataFrame, at: Column) -> DataFrame:
    """All live entries at a time."""
    return latest(log).where(live(at))


def purge_count(log: DataFrame, at: Column) -> DataFrame:
    gone = latest(log).where(F.col("value").isNotNull() & (F.col("expires_at") <= at))
    return gone.groupBy("ns").agg(F.count("*").alias("purged"))


def persist(log: DataFrame, at: Column, path: str) -> None:
    """Save what is persistent and alive."""
    snapshot(log, at).where("persistent").write.mode("overwrite").option("compression", "gzip").json(path)


def load(spark, path: str, at: Column) -> DataFrame:
    """Saved entries that are still alive; none where nothing was saved."""
    schema = "ns string, key string, value string, written_at timestamp, expires_at timestamp, persistent boolean, seq long"
    try:
        rows = spark.read.schema(schema).json(path)
        rows.schema  # noqa: B018
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], schema)
    return rows.where("key is not null").where(live(at))


def preload(spark, script) -> DataFrame:
    """Seed writes of a callable that returns rows of WRITES."""
    rows = script()
    if not isinstance(rows, list):
        raise TypeError("a preload script returns a list of writes")
    return writes(spark.createDataFrame(rows, WRITES))
