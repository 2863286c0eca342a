"""Rules over streams: the exact engine as keyed state with event-time timers."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.exact import OUTCOME, event_of, frame, outcome_rows
from millrace.operators.fold import Engine, Event, Instance
from millrace.operators.rule import ANY, Rule

STATE = "saved binary"


def save(engine: Engine) -> bytes:
    """Waiting instances with their timeouts, as plain values; rules are named, not stored."""
    rows = []
    for i in engine.waiting:
        chain = [(e.event, e.datetime, e.id, e.data) for e in i.chain]
        rows.append((i.rule.name, chain, i.step, i.seen, i.first, i.timeout, i.context))
    return pickle.dumps((rows, engine.clock, engine.stats))


def restore(saved: bytes, rules: list[Rule]) -> Engine:
    """Instances of rules that aren't registered any more are left out."""
    engine, by_name = Engine(rules), {r.name: r for r in rules}
    rows, engine.clock, engine.stats = pickle.loads(saved)
    for name, chain, *rest in rows:
        if name in by_name:
            engine.wait(Instance(by_name[name], [Event(*e) for e in chain], *rest))
    return engine


def run(events: DataFrame, rules: list[Rule], key: str, delay: str | None = "0 seconds", phases: tuple[str, ...] = ("complete", "timeout"), timers: bool = True) -> DataFrame:
    """Outcomes of a stream (event_id, ts, event_type, value, key). Each batch's events of a key are put in order, timeouts
    are expired before each event, and what is left fires when the watermark passes it.

    With a delay of None there is no watermark: no event is dropped however late it comes, and a timeout fires when a later
    event of its key, or with timers the clock of the machine, has passed it. With such timers a query doesn't end by itself."""
    types = set().union(*[r.types for r in rules])
    read = events.select("event_id", "ts", "event_type", "value", key)
    read = read if delay is None else read.withWatermark("ts", delay)
    if ANY not in types:
        # The second term never holds. It keeps the filter above the watermark, which events of all types move.
        read = read.where(F.col("event_type").isin(sorted(types)) | (F.col("ts") < F.lit("0001-01-01").cast("timestamp")))
    tick = timedelta(milliseconds=1)

    def step(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        engine = restore(state.get[0], rules) if state.exists else Engine(rules)
        groups = [b for b in batches if len(b)]
        if groups:
            for row in pd.concat(groups).sort_values(["ts", "event_id"], kind="stable").itertuples(index=False):
                engine.handle(event_of(row))
        mark = state.getCurrentProcessingTimeMs() if delay is None else state.getCurrentWatermarkMs()
        if mark > 0 and (delay is not None or state.hasTimedOut):
            engine.advance(pd.Timestamp(mark, unit="ms").to_pydatetime() - tick)
        rows = outcome_rows(engine, phases)
        if engine.waiting:
            state.update((save(engine),))
            due = engine.next_timeout()
            if due is not None and delay is None and timers:
                state.setTimeoutDuration(max(1, int(pd.Timestamp(due).value // 1_000_000) + 1 - mark))
            elif due is not None and delay is not None:
                state.setTimeoutTimestamp(max(int(pd.Timestamp(due).value // 1_000_000) + 1, mark + 1))
        elif state.exists:
            state.remove()
        yield frame(rows)

    live = GroupStateTimeout.ProcessingTimeTimeout if timers else GroupStateTimeout.NoTimeout
    timeout = live if delay is None else GroupStateTimeout.EventTimeTimeout
    return read.groupBy(key).applyInPandasWithState(step, OUTCOME, STATE, "append", timeout)


def counts(events: DataFrame, window: str = "1 second", delay: str = "0 seconds") -> DataFrame:
    """Events of each window, with late data dropped behind the watermark."""
    made = events.withWatermark("ts", delay).groupBy(F.window("ts", window)).agg(F.count("*").alias("n_events"))
    return made.select(F.col("window.start").alias("start"), "n_events")


def sessions(events: DataFrame, types: set[str], key: str, gap: str, delay: str = "0 seconds") -> DataFrame:
    made = events.where(F.col("event_type").isin(sorted(types))).withWatermark("ts", delay)
    made = made.groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return made.drop("session_window")
