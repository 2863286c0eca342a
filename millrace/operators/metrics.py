"""Counters, rates, histograms and recent events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PACKET_BOUNDS = [64 << i for i in range(15)]


def counters(events: DataFrame, group: str, name: Column) -> DataFrame:
    return events.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(group).alias("group_name"), "name", "n")


def per_second(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.groupBy(F.unix_seconds(F.col(ts)).alias("second")).agg(F.count("*").alias("n_events"))


def per_second_filled(events: DataFrame, seconds: int = 3600, ts: str = "ts") -> DataFrame:
    """Events of each of the last seconds up to the last event's, zero where there are none."""
    counted = per_second(events, ts)
    last = events.select(F.max(F.unix_seconds(F.col(ts))).alias("last")).where("last is not null")
    slots = last.select(F.explode(F.sequence(F.col("last") - (seconds - 1), F.col("last"))).alias("second"))
    return slots.join(counted, "second", "left").select("second", F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"))


def load_averages(events: DataFrame, spans: tuple[int, ...] = (3600, 900, 60)) -> DataFrame:
    """At each second with events, events a second over the spans that end with it, rounded to two digits.

    A span reaches over at most one bucket border when buckets are as long as the longest span: rows are copied to the
    next bucket, so each bucket's window has what it needs and no window spans the whole stream.
    """
    longest = max(spans)
    seconds = per_second(events).withColumn("own", F.floor(F.col("second") / longest))
    copies = seconds.select("second", "n_events", "own", F.explode(F.array("own", F.col("own") + 1)).alias("bucket"))
    w = Window.partitionBy("bucket").orderBy("second")
    rates = [F.round(F.sum("n_events").over(w.rangeBetween(1 - s, 0)) / s, 2).alias(f"load_{s}") for s in spans]
    return copies.select("second", "own", "bucket", *rates).where("own = bucket").drop("own", "bucket")


def bucket_of(value: Column, bounds: list[float]) -> Column:
    """The first bound that a value doesn't exceed, as text; +Inf beyond all."""
    found = F.lit("+Inf")
    for b in sorted(bounds, reverse=True):
        found = F.when(value <= b, F.lit(f"{b:g}" if b < 1e5 else str(b))).otherwise(found)
    return found


def histogram(rows: DataFrame, value: Column, bounds: list[float]) -> DataFrame:
    """Counts by bucket; empty buckets are left out."""
    return rows.where(value.isNotNull()).groupBy(bucket_of(value, bounds).alias("bucket")).agg(F.count("*").alias("n"))


def recent(events: DataFrame, n: int = 100) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
