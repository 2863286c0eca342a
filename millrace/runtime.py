"""The engine's face: register rules, sources and actions; run over tables or streams; report status."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable
from datetime import datetime
from enum import Enum
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from millrace import streaming
from millrace.operators import exact, memory, patterns, temporal
from millrace.operators.actions import Registry
from millrace.operators.fold import Engine, Event
from millrace.operators.rule import Rule, RuleSet
from millrace.sources import SourceRegistry
from millrace.state import Metrics, Store

#: Runs of one source that a table of requests may lead to.
MOST_RUNS = 100


class State(Enum):
    STARTING = "starting"
    RECOVERY = "recovery"
    RUNNING = "running"
    STOPPING = "stopping"
    STOPPED = "stopped"
    UNCLEAN = "stopped uncleanly"


NEXT = {
    State.STARTING: {State.RECOVERY, State.RUNNING},
    State.RECOVERY: {State.RUNNING, State.STOPPING, State.UNCLEAN},
    State.RUNNING: {State.STOPPING, State.UNCLEAN},
    State.STOPPING: {State.STOPPED, State.UNCLEAN},
    State.STOPPED: set(),
    State.UNCLEAN: {State.RECOVERY},
}


class Runtime:
    """Sources in, rules over them, actions out."""

    def __init__(self, spark: SparkSession, rules: list[Rule] = (), checkpoint: str | None = None):
        self.spark, self.rules, self.checkpoint = spark, RuleSet(list(rules)), checkpoint
        self.sources, self.actions, self.queries = SourceRegistry(), Registry(), {}
        self.state, self.seed, self.metrics = State.STARTING, None, Metrics()
        #: Action that emitted events are given to, instead of coming back in.
        self.event_action: str | None = None

    def move(self, to: State) -> None:
        if to not in NEXT[self.state]:
            raise RuntimeError(f"no way from {self.state.value} to {to.value}")
        self.state = to

    def preload(self, script) -> DataFrame:
        self.seed = memory.preload(self.spark, script)
        return self.seed

    def run_batch(self, events: DataFrame, key: str) -> DataFrame:
        """Outcomes of all rules. Rules with a closed form become windows, others are folded exactly; both give the same."""
        self.move(State.RUNNING) if self.state is State.STARTING else None
        closed = [r for r in self.rules.rules if r.mode == "sequence" and r.closed_form and r.keys == (key,)]
        parts = [self._closed(events, r) for r in closed]
        rest = [r for r in self.rules.rules if r not in closed and r.mode != "schedule"]
        if rest:
            phases = ("complete", "timeout", "passed", "failed")
            parts.append(exact.run(events, rest, key, phases).select("rule", "phase", "first_id"))
        if not parts:
            return self.spark.createDataFrame([], "rule string, phase string, first_id long")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _closed(self, events: DataFrame, rule: Rule) -> DataFrame:
        made = patterns.sequence(events, rule)
        done = F.col(f"id{len(rule.steps)}").isNotNull()
        late = F.col("deadline") <= patterns.stream_end(events) - patterns.tick()
        phase = F.when(done, "complete").when(late, "timeout")
        return made.select(F.lit(rule.name).alias("rule"), phase.alias("phase"), F.col("id1").alias("first_id")).where("phase is not null")

    def run_emits(self, events: DataFrame, key: str) -> dict[str, DataFrame]:
        """What the rules emit over a table, by kind: events (which have gone through the rules of their key, too), actions
        with cmd and vars for the registry, source runs, writes to the memory, and kinds of one's own."""
        made = exact.emits(events, [r for r in self.rules.rules if r.mode != "schedule"], key, event_action=self.event_action)
        actions = made.where("kind = 'action'").select(F.col("name").alias("cmd"), F.get_json_object("payload", "$.vars").alias("vars"), "rule", "at")
        return {"all": made, "actions": self.actions.dispatch(actions), **{k: made.where(F.col("kind") == k) for k in ("event", "source", "memory")}}

    def run_sources(self, asked: DataFrame) -> dict[str, DataFrame]:
        """Tables of the on-demand sources that rules ask for; each is run once for each of its settings."""
        found = {}
        wanted = asked.select("name", F.get_json_object("payload", "$.vars").alias("vars")).distinct()
        for row in wanted.limit(len(self.sources.sources) * MOST_RUNS + 1).collect():
            found[f"{row['name']}:{row['vars']}"] = self.sources.run(self.spark, row["name"], json.loads(row["vars"] or "{}"))
            if len(found) > len(self.sources.sources) * MOST_RUNS:
                raise RuntimeError("rules ask for more source runs than a driver should start")
        return found

    def ticks(self, events: DataFrame) -> DataFrame:
        """(rule, at): every tick of the schedule rules between the table's first and last time."""
        bounds = events.agg(F.min("ts").alias("start"), F.max("ts").alias("stop"))
        parts = [
            temporal.cron_ticks(bounds, r.schedule, r.zone).select(F.lit(r.name).alias("rule"), F.col("tick").alias("at"))
            for r in self.rules.rules
            if r.mode == "schedule"
        ]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "rule string, at timestamp")

    def save_state(self, store: Store) -> int:
        """Rules' names, checkpoints and metrics; keyed state is in the streams' own checkpoints."""
        return store.save({"rules": [r.name for r in self.rules.rules], "checkpoints": self.sources.checkpoints, "metrics": self.metrics.snapshot(), "state": self.state.value})

    def load_state(self, store: Store) -> list[str]:
        """Take a saved state up; returns the names of rules that aren't registered any more."""
        saved = store.load() or {"rules": [], "checkpoints": {}, "metrics": {}}
        self.sources.checkpoints |= saved["checkpoints"]
        self.metrics.values |= saved["metrics"]
        return [n for n in saved["rules"] if all(r.name != n for r in self.rules.rules)]

    def run_stream(self, events: DataFrame, key: str, sink, name: str = "rules", delay: str | None = "0 seconds", once: bool = False) -> StreamingQuery:
        """Outcomes to ``sink(batch, batch_id)``. State and offsets are in the checkpoint folder. Without a delay, late events
        are taken, too."""
        made = streaming.run(events, self.rules.rules, key, delay, timers=not once)
        writer = made.writeStream.foreachBatch(sink).queryName(name).outputMode("append")
        if self.checkpoint:
            writer = writer.option("checkpointLocation", f"{self.checkpoint}/{name}")
        query = (writer.trigger(availableNow=True) if once else writer).start()
        self.queries[name] = query
        return query

    def emit(self, original: DataFrame, derived: DataFrame) -> DataFrame:
        """Derived events among the original ones, for the next rules."""
        return original.unionByName(derived, allowMissingColumns=True)

    def status(self) -> dict:
        running = {n: q.status for n, q in self.queries.items()}
        progress = {n: q.lastProgress for n, q in self.queries.items()}
        return {
            "state": self.state.value,
            "rules": [r.name for r in self.rules.rules],
            "sources": {n: self.sources.checkpoints.get(n) for n in self.sources.sources},
            "actions": sorted(self.actions.actions),
            "queries": running,
            "progress": progress,
            "metrics": self.metrics.snapshot(),
        }

    def stop(self, store: Store | None = None) -> None:
        """First the streams, whose actions run in their batches, then the last state. What fails makes the end unclean."""
        self.move(State.STOPPING)
        try:
            for query in self.queries.values():
                query.stop()
            if store:
                self.save_state(store)
        except Exception:
            self.move(State.UNCLEAN)
            raise
        self.move(State.STOPPED)


class Driver:
    """Rules event by event in one process, to look at: for tests and for trying rules out."""

    def __init__(self, rules: list[Rule], live: bool = False):
        self.engine = Engine(rules, live)
        self.events: deque[Event] = deque()
        self.before: list[Callable[[Event], None]] = []
        self.after: list[Callable[[Event, list], None]] = []

    def queue(self, *events: Event) -> None:
        self.events.extend(events)

    def step(self) -> list:
        """Handle one event; returns what it led to."""
        event = self.events.popleft()
        for look in self.before:
            look(event)
        self.engine.handle(event)
        made = self.engine.take_emitted()
        for look in self.after:
            look(event, made)
        return made

    def run(self) -> list:
        made = []
        while self.events:
            made += self.step()
        return made

    @property
    def next_timer(self) -> datetime | None:
        return self.engine.next_timeout()
