"""The exact engine over keyed tables: an ordered fold for each correlation key (batch).

Rows are dealt by key and sorted by key and time within partitions; a task streams through its keys one after the other and
holds one engine, not a key's rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import TICK, Engine, Event
from .rule import ANY, Rule

OUTCOME = "rule string, phase string, n_events long, first_id long, last_id long, at timestamp"
EMITTED = "kind string, rule string, name string, at timestamp, payload string"
STATS = "group_name string, name string, n long"
#: Rows that a task gathers before it gives them on.
ROWS = 8192


def event_of(row) -> Event:
    return Event(row.event_type, row.ts.to_pydatetime().replace(tzinfo=None), int(row.event_id), row._asdict())


def outcome_rows(engine: Engine, phases: tuple[str, ...]) -> list[tuple]:
    rows = []
    for name, phase, instance, at in engine.take():
        if phase in phases:
            chain = instance.chain
            rows.append((name, phase, instance.seen, chain[0].id if chain else None, chain[-1].id if chain else None, at))
    return rows


def emitted_rows(engine: Engine) -> list[tuple]:
    rows = []
    for kind, made, rule, at in engine.take_emitted():
        name = getattr(made, "event", None) or getattr(made, "cmd", None) or getattr(made, "name", None) or type(made).__name__
        rows.append((kind, rule, name, at, json.dumps(asdict(made) if hasattr(made, "__dataclass_fields__") else made, default=str)))
    return rows


def stat_rows(engine: Engine) -> list[tuple]:
    rows = [(group, name, n) for (group, name), n in engine.stats.items()]
    engine.stats = {}
    return rows


def frame(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["rule", "phase", "n_events", "first_id", "last_id", "at"])
    made["at"] = pd.to_datetime(made["at"]).astype("datetime64[ns]")
    return made.astype({"n_events": "int64", "first_id": "int64", "last_id": "int64"})


def folded(events: DataFrame, rules: list[Rule], key: str, schema: str, rows_of: Callable[[Engine], list[tuple]], flush: bool = True, event_action: str | None = None) -> DataFrame:
    """What ``rows_of`` takes from the engine of each key, after each of its events and at its end."""
    types = set().union(*[r.types for r in rules])
    columns = ["event_id", "ts", "event_type", "value", *[c for r in rules for c in r.keys], key]
    columns = list(dict.fromkeys(columns))
    read = events.select(*columns)
    if ANY not in types:
        read = read.where(F.col("event_type").isin(sorted(types)))
    last = events.select(F.max("ts")).scalar()
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "timestamp": pa.timestamp("us", "UTC")}
    arrow = pa.schema([(n, kinds[part.split()[1]]) for n, part in zip(names, schema.split(", "), strict=True)])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, now, end, rows = None, None, None, []

        def finish() -> None:
            if engine is not None:
                if flush and end is not None:
                    engine.advance(end - TICK)
                rows.extend(rows_of(engine))

        for batch in batches:
            at_key = columns.index(key)
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if engine is None or row[at_key] != now:
                    finish()
                    engine, now = Engine(rules, event_action=event_action), row[at_key]
                    end = row[-1].replace(tzinfo=None) if row[-1] else None
                engine.handle(Event(row[2], row[1].replace(tzinfo=None), row[0], dict(zip(columns, row, strict=False))))
                if len(engine.out) + len(engine.emitted) > 256:
                    rows.extend(rows_of(engine))
                if len(rows) >= ROWS:
                    yield batch_of(rows)
                    rows = []
        finish()
        if rows:
            yield batch_of(rows)

    dealt = read.withColumn("stream_end", last).repartition(key).sortWithinPartitions(key, "ts", "event_id")
    return dealt.mapInArrow(run, schema)


def run(
    events: DataFrame, rules: list[Rule], key: str, phases: tuple[str, ...] = ("complete", "timeout"), flush: bool = True
) -> DataFrame:
    """Outcomes of rules that all correlate on ``key``. The stream's last time flushes what timed out by then.

    One key's events are folded in one task, as order within a key is what the rules are about.
    """

    def rows_of(engine: Engine) -> list[tuple]:
        engine.take_emitted()
        return outcome_rows(engine, phases)

    return folded(events, rules, key, OUTCOME, rows_of, flush)


def emits(events: DataFrame, rules: list[Rule], key: str, flush: bool = True, event_action: str | None = None) -> DataFrame:
    """What the callbacks of the rules emit: (kind, rule, name, at, payload as JSON). Emitted events go through the rules of
    the same key, too, or to the action named."""

    def rows_of(engine: Engine) -> list[tuple]:
        engine.take()
        return emitted_rows(engine)

    return folded(events, rules, key, EMITTED, rows_of, flush, event_action)


def stats(events: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """The engine's counters (group_name, name, n) over all keys."""

    def rows_of(engine: Engine) -> list[tuple]:
        engine.take(), engine.take_emitted()
        return stat_rows(engine)

    return folded(events, rules, key, STATS, rows_of).groupBy("group_name", "name").agg(F.sum("n").alias("n"))
