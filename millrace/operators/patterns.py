"""Closed-form patterns as windows and aggregates over (event_id, ts, event_type, value, ...) tables.

All keyed patterns use one window spec (partition by the key, order by ts and event_id), so Spark shuffles and sorts a table
once for any number of them.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rule import ANY, Rule

def tick() -> Column:
    """How far the batch clock stays behind the event that moves it."""
    return F.expr("interval 1 millisecond")


def span(t: timedelta) -> Column:
    return F.make_dt_interval(F.lit(t.days), F.lit(0), F.lit(0), F.lit(t.seconds + t.microseconds / 1e6))


def of_types(types) -> Column:
    return F.lit(True) if ANY in types else F.col("event_type").isin(sorted(types))


def ordered(key: str):
    return Window.partitionBy(key).orderBy("ts", "event_id")


def stream_end(events: DataFrame) -> Column:
    """The stream's last time, as a scalar subquery."""
    return events.select(F.max("ts")).scalar()


def single(events: DataFrame, rule: Rule) -> DataFrame:
    """Every matching event is one completed instance."""
    return events.where(of_types(rule.steps[0]))


def sequence(events: DataFrame, rule: Rule) -> DataFrame:
    """Each event of the first step with what the next steps matched: columns id1, ts1, value1, id2, ts2, ...

    Step i+1 is the first event of its types after step i, whatever its time; it counts if it is within the timeout. Where
    it isn't (or there is none) the later columns are null. ``deadline`` is when the last reached step times out.
    """
    if not rule.closed_form or len(rule.keys) != 1:
        raise ValueError("the first step's types must not come again, and there must be one key")
    key, steps, ahead = rule.keys[0], rule.steps, None
    frame = events.where(of_types(rule.types))
    after = ordered(key).rowsBetween(1, Window.unboundedFollowing)
    for i in range(len(steps) - 1, 0, -1):
        fields = ["event_id", "ts", "value"] + ([F.col(ahead).alias("next")] if ahead else [])
        ahead = f"next{i}"
        frame = frame.withColumn(ahead, F.first(F.when(of_types(steps[i]), F.struct(*fields)), ignorenulls=True).over(after))
    frame = frame.where(of_types(steps[0]))
    out = [F.col(key), F.col("event_id").alias("id1"), F.col("ts").alias("ts1"), F.col("value").alias("value1")]
    met, last, path = F.lit(True), F.col("ts"), F.col(ahead) if ahead else None
    for i in range(1, len(steps)):
        ok = met & path["ts"].isNotNull()
        if rule.timeout is not None and not rule.ignore_timeout_in_batch:
            ok = ok & (path["ts"] <= last + span(rule.timeout))
        out += [F.when(ok, path[c]).alias(f"{n}{i + 1}") for n, c in (("id", "event_id"), ("ts", "ts"), ("value", "value"))]
        last, met = F.when(ok, path["ts"]).otherwise(last), ok
        path = path["next"] if i + 1 < len(steps) else None
    deadline = last + span(rule.timeout) if rule.timeout is not None else F.lit(None).cast("timestamp")
    return frame.select(*out, deadline.alias("deadline"))


def completed(events: DataFrame, rule: Rule) -> DataFrame:
    return sequence(events, rule).where(F.col(f"id{len(rule.steps)}").isNotNull())


def timed_out(events: DataFrame, rule: Rule) -> DataFrame:
    """Instances that time out before the stream ends: a later event was late, or the clock went past the deadline."""
    open_ones = sequence(events, rule).where(F.col(f"id{len(rule.steps)}").isNull())
    return open_ones.where(F.col("deadline") <= stream_end(events) - tick())


def pending(events: DataFrame, rule: Rule) -> DataFrame:
    open_ones = sequence(events, rule).where(F.col(f"id{len(rule.steps)}").isNull())
    return open_ones.where(F.col("deadline").isNull() | (F.col("deadline") > stream_end(events) - tick()))


def next_of_any(events: DataFrame, first: set[str], then: set[str], within: timedelta, bucket: str = "hour") -> DataFrame:
    """Uncorrelated sequence: the next event of ``then`` by anyone after each of ``first``.

    Windows run within time buckets; what a bucket lacks comes from the first event of a later bucket, looked up in a table
    of one row for each bucket. No task holds more than a bucket.
    """
    read = events.where(of_types(first | then)).withColumn("bucket", F.date_trunc(bucket, "ts"))
    here = F.when(of_types(then), F.struct("ts", "event_id"))
    after = Window.partitionBy("bucket").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    near = read.withColumn("near", F.first(here, ignorenulls=True).over(after)).where(of_types(first))
    firsts = read.groupBy("bucket").agg(F.min(here).alias("first"))
    later = Window.orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    far = firsts.select("bucket", F.first("first", ignorenulls=True).over(later).alias("far"))
    both = near.join(far, "bucket").withColumn("nxt", F.coalesce("near", "far"))
    found = both.where(F.col("nxt.ts") <= F.col("ts") + span(within))
    return found.select(F.col("event_id").alias("id1"), F.col("ts").alias("ts1"), F.col("nxt.event_id").alias("id2"), F.col("nxt.ts").alias("ts2"))


def pairs(events: DataFrame, types: set[str], key: str, within: timedelta | None = None) -> DataFrame:
    """Consecutive, non-overlapping pairs of the same types by key (no timeout: the first with the second, and so on)."""
    if within is not None:
        raise ValueError("pairs with a timeout need the exact engine")
    w = ordered(key)
    n, nxt = F.row_number().over(w).alias("n"), F.lead(F.struct("event_id", "ts")).over(w).alias("nxt")
    numbered = events.where(of_types(types)).select(key, "event_id", "ts", n, nxt)
    made = numbered.where("n % 2 = 1 and nxt is not null")
    return made.select(key, F.col("event_id").alias("id1"), F.col("nxt.event_id").alias("id2"), ((F.col("n") + 1) / 2).cast("long").alias("nth"))


def running(events: DataFrame, types: set[str], key: str) -> DataFrame:
    """One instance that absorbs every matching event: its count and sum so far, at each of them."""
    w = ordered(key).rowsBetween(Window.unboundedPreceding, 0)
    cents = F.sum(F.round("value", 2).cast("decimal(18,2)")).over(w).cast("double")
    return events.where(of_types(types)).select(key, "event_id", F.count("*").over(w).alias("n_seen"), cents.alias("value_sum"))


def last_n(events: DataFrame, n: int, key: str) -> DataFrame:
    """At each event, the key's last n events (it included)."""
    if n <= 0:
        raise ValueError("n must be positive")
    w = ordered(key).rowsBetween(1 - n, 0)
    return events.withColumn("buffer", F.collect_list(F.struct("event_id", "event_type", "value")).over(w))


def sessions(events: DataFrame, types: set[str], key: str, gap: timedelta) -> DataFrame:
    """Runs of events no further apart than the gap (a gap of exactly that still joins)."""
    seconds = f"{gap.total_seconds():.6f} seconds"
    window = F.session_window("ts", seconds)
    made = events.where(of_types(types)).groupBy(key, window)
    return made.agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("session_window")


def anchored(events: DataFrame, types: set[str], key: str, length: timedelta) -> DataFrame:
    """Windows that start with the first event after the last window's end, and take in what comes until then.

    Greedy, so a fold in each key, but over times only; a task streams through its keys and holds one batch.
    """
    import numpy as np
    import pyarrow as pa

    width = length // timedelta(microseconds=1)

    def run(batches):
        now, began, held = None, 0, 0
        for batch in batches:
            rows = []
            keys, t = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                at = lo
                if keys[lo] != now:
                    if now is not None:
                        rows.append((now, began, held))
                    now, began, held = int(keys[lo]), int(t[lo]), 0
                while True:
                    end = at + int(np.searchsorted(t[at:hi], began + width, "right"))
                    held += end - at
                    if end == hi:
                        break
                    rows.append((now, began, held))
                    at, began, held = end, int(t[end]), 0
            yield made_of(rows)
        if now is not None:
            yield made_of([(now, began, held)])

    def made_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["key", "us", "n_events"])

    read = events.where(of_types(types) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.unix_micros("ts").alias("us"))
    made = read.repartition("key").sortWithinPartitions("key", "us").mapInArrow(run, "key long, us long, n_events long")
    return made.select(F.col("key").alias(key), F.timestamp_micros("us").alias("first_ts"), "n_events")


def first_event_of(events: DataFrame, key: str | None, types: set[str] | None = None) -> DataFrame:
    """First and last event of each type for each key, or without a key over all events."""
    read = events.where(of_types(types)) if types else events
    order = F.struct("ts", "event_id")
    return read.groupBy(*[key] if key else [], "event_type").agg(
        F.min_by("event_id", order).alias("first_id"), F.max_by("event_id", order).alias("last_id"), F.count("*").alias("n_events")
    )


def suppress(events: DataFrame, rules: list[tuple[str, Column, bool]]) -> DataFrame:
    """(event, rule) for ordered rules (name, predicate, suppresses): a suppressing match keeps the event from later ones.
    Give rules of an event's type before those of any, as the exact engine takes them."""
    last = F.lit(len(rules))
    stop = F.least(*[F.when(p, F.lit(i)).otherwise(last) for i, (_, p, s) in enumerate(rules) if s], last, last)
    hits = F.array_compact(F.array(*[F.when(p & (stop >= i), F.lit(n)) for i, (n, p, _) in enumerate(rules)]))
    return events.withColumn("rule", F.explode(hits))


def validate_enrich_filter(events: DataFrame, valid: Column, enrich, keep: Column) -> DataFrame:
    """Events through three stages, as columns: all events with what ``enrich`` (a function of tables) adds, and ``passed``.

    What isn't known to pass a stage is rejected. The original event goes on where it passes; ``unsuppressed`` takes those.
    """
    made = enrich(events.withColumn("passed", F.coalesce(valid, F.lit(False))))
    return made.withColumn("passed", F.col("passed") & F.coalesce(keep, F.lit(False)))


def unsuppressed(staged: DataFrame) -> DataFrame:
    """What later rules see: a rejected event is suppressed."""
    return staged.where("passed").drop("passed")
