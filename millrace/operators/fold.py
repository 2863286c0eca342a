"""The exact engine: events in order through waiting and new instances of every rule. Plain Python, no Spark.

Instances stand in one table for each event type they wait for, and their timeouts in a heap, so an event costs what it
concerns. What callbacks return is emitted: events come back in after the event at hand, all others are given out.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from itertools import count
from typing import Any

from .rule import ANY, CONTROL, STOP, Result, Rule

TICK = timedelta(milliseconds=1)
#: How far a live event's time may be from the clock's before it gets that, and how many events one may lead to.
MOST_VARIANCE, MOST_EMITTED = timedelta(seconds=600), 10_000


@dataclass
class Event:
    event: str
    datetime: datetime
    id: Any = None
    data: dict = field(default_factory=dict)

    def get(self, name: str):
        return getattr(self, name) if name in ("event", "datetime", "id") else self.data.get(name)


@dataclass(frozen=True)
class Action:
    cmd: str
    vars: dict = field(default_factory=dict)


@dataclass(frozen=True)
class SourceRun:
    name: str
    vars: dict = field(default_factory=dict)


@dataclass(frozen=True)
class MemoryWrite:
    """Value None deletes; a lifetime of 0 seconds is for ever."""

    ns: str
    key: str
    value: Any
    ttl_s: int = 0
    persistent: bool = True


class Recall:
    """What rules may read of the shared memory: live entries as of a time."""

    def __init__(self):
        self.entries: dict[tuple[str, str], tuple[Any, datetime | None]] = {}

    def write(self, w: MemoryWrite, at: datetime) -> None:
        if w.value is None:
            self.entries.pop((w.ns, w.key), None)
        else:
            self.entries[w.ns, w.key] = (w.value, at + timedelta(seconds=w.ttl_s) if w.ttl_s else None)

    def get(self, ns: str, key: str, at: datetime, default=None):
        value, until = self.entries.get((ns, key), (default, None))
        return default if until is not None and until <= at else value

    def has(self, ns: str, key: str, at: datetime) -> bool:
        return self.get(ns, key, at) is not None

    def all(self, ns: str, at: datetime) -> dict:
        return {k: v for (n, k), (v, until) in self.entries.items() if n == ns and (until is None or until > at)}

    def purge(self, at: datetime) -> int:
        gone = [k for k, (_, until) in self.entries.items() if until is not None and until <= at]
        for k in gone:
            del self.entries[k]
        return len(gone)


@dataclass(eq=False)
class Instance:
    rule: Rule
    chain: list[Event] = field(default_factory=list)
    step: int = 0
    seen: int = 0
    first: datetime | None = None
    timeout: datetime | None = None
    context: dict = field(default_factory=dict)
    stopped: bool = False
    memory: Recall | None = None

    @property
    def awaited(self) -> tuple[str, ...]:
        if self.rule.mode == "schedule" and self.seen:
            return (STOP,)
        return self.rule.steps[min(self.step, len(self.rule.steps) - 1)]

    def accepts(self, event: Event) -> bool:
        if self.complete:
            return False
        types = self.awaited
        if event.event not in types and ANY not in types:
            return False
        if self.seen and any(event.get(k) != self.chain[0].get(k) for k in self.rule.keys):
            return False
        return self.rule.accept is None or bool(self.rule.accept(event, self))

    def handle(self, event: Event) -> Result:
        if self.rule.handler is not None:
            return Result(self.rule.handler(event, self))
        if not self.accepts(event):
            return Result.SKIPPED
        if self.timeout and event.datetime > self.timeout and self.rule.mode != "schedule":
            return Result.SKIPPED | Result.TIMEOUT
        self.consume(event)
        suppress = self.rule.suppress
        if self.rule.mode == "vef":
            made: Event | None = Event(event.event, event.datetime, event.id, dict(event.data))
            for stage in self.rule.stages:
                made = stage(made) if made is not None else None
            self.context["event"] = made
            suppress = made is None
        return Result.HANDLED | (Result.SUPPRESS if suppress else Result(0))

    @property
    def complete(self) -> bool:
        if self.rule.mode == "schedule":
            return self.stopped
        return self.rule.mode in ("single", "sequence", "vef") and self.step >= len(self.rule.steps)

    def consume(self, event: Event) -> None:
        self.stopped = event.event == STOP
        self.chain.append(event)
        self.seen += 1
        self.step += 1
        self.first = self.first or event.datetime

    def rearm(self, live: bool, now: datetime | None = None) -> None:
        rule = self.rule
        if rule.keep_last is not None and self.seen > 1:
            self.chain = self.chain[-rule.keep_last :] if rule.keep_last else []
        if rule.timeout_at is not None:
            self.timeout = rule.timeout_at(self, live)
        elif rule.mode == "schedule":
            from .temporal import Cron

            after = now if live and now else max(self.first, self.context.get("ran", self.first))
            self.timeout = None if self.stopped else Cron.parse(rule.schedule).next_after(after, rule.zone)
        elif rule.timeout is None or rule.ignore_timeout_in_batch and not live:
            self.timeout = None
        elif rule.mode == "anchored":
            self.timeout = self.first + rule.timeout
        else:
            self.timeout = self.last + rule.timeout

    @property
    def last(self) -> datetime:
        return self.chain[-1].datetime if self.chain else self.first


class Engine:
    """Feeds events to rules. Outcomes are (rule, phase, instance, time); phases are progress, complete, timeout, passed,
    failed and schedule. ``emitted`` has (kind, object, rule, time), kind being event, action, source, memory or one of
    add_emit. With ``event_action``, emitted events are given to the action of that name and don't come back in."""

    def __init__(self, rules: list[Rule], live: bool = False, event_action: str | None = None):
        self.rules, self.live, self.event_action = list(rules), live, event_action
        self.clock = datetime(1970, 1, 1)
        self.stats: dict[tuple[str, str], int] = {}
        self.out: list[tuple[str, str, Instance, datetime]] = []
        self.emitted: list[tuple[str, Any, str, datetime]] = []
        self.emits: dict[str, type] = {"event": Event, "action": Action, "source": SourceRun, "memory": MemoryWrite}
        self.memory = Recall()
        self._again: deque[Event] = deque()
        self._open: dict[int, Instance] = {}
        self._watch: dict[str, dict[int, Instance]] = defaultdict(dict)
        self._due: list[tuple[datetime, int, Instance]] = []
        self._nth = count()
        self._first: dict[str, list[Rule]] = defaultdict(list)
        self._begins: dict[str, list[Rule]] = {}
        for rule in self.rules:
            for kind in dict.fromkeys(rule.steps[0]):
                self._first[kind].append(rule)

    # --- instances --------------------------------------------------------------------------------------------------------

    @property
    def waiting(self) -> list[Instance]:
        return list(self._open.values())

    def wait(self, instance: Instance) -> None:
        """Take an instance in, or note what it waits for now."""
        self._leave(instance)
        instance.memory = self.memory
        self._open[id(instance)] = instance
        for kind in instance.awaited:
            self._watch[kind][id(instance)] = instance
        self._arm(instance)

    def _leave(self, instance: Instance) -> None:
        self._open.pop(id(instance), None)
        for kind in {t for s in instance.rule.steps for t in s} | {STOP}:
            self._watch.get(kind, {}).pop(id(instance), None)

    def _arm(self, instance: Instance) -> None:
        if instance.timeout is not None:
            heapq.heappush(self._due, (instance.timeout, next(self._nth), instance))

    def next_timeout(self) -> datetime | None:
        while self._due and not self._valid(self._due[0]):
            heapq.heappop(self._due)
        return self._due[0][0] if self._due else None

    def _valid(self, entry: tuple[datetime, int, Instance]) -> bool:
        return id(entry[2]) in self._open and entry[2].timeout == entry[0]

    # --- what comes out ---------------------------------------------------------------------------------------------------

    def _count(self, group: str, name: str) -> None:
        self.stats[group, name] = self.stats.get((group, name), 0) + 1

    def add_emit(self, name: str, kind: type) -> None:
        """A further kind of object that callbacks may return."""
        if not (name.isascii() and name.isalpha()):
            raise ValueError("the name of a kind has only letters")
        if not isinstance(kind, type):
            raise TypeError(f"not a class: {kind!r}")
        self.emits[name] = kind

    def emit(self, made, rule: str, at: datetime) -> None:
        for one in made if isinstance(made, (list, tuple)) else [made]:
            kind = next((k for k, c in self.emits.items() if isinstance(one, c)), None)
            if kind is None:
                raise TypeError(f"{rule} emits {one!r}, which is of no kind that is known")
            self._count(f"emit_{kind}", getattr(one, "event", None) or getattr(one, "cmd", None) or type(one).__name__)
            self.emitted.append((kind, one, rule, at))
            if kind == "event" and self.event_action:
                self.emitted.append(("action", Action(self.event_action, vars(one)), rule, at))
            elif kind == "event":
                self._again.append(one)
            elif kind == "memory":
                self.memory.write(one, at)

    def _call(self, instance: Instance, at: datetime, *phases: str) -> None:
        for phase in phases:
            if callback := instance.rule.callbacks.get(phase):
                made = callback(at if phase == "schedule" else instance)
                if made is not None:
                    self.emit(made, instance.rule.name, at)

    def _note(self, phase: str, instance: Instance, at: datetime, *calls: str) -> None:
        self.out.append((instance.rule.name, phase, instance, at))
        self._call(instance, at, *calls)

    def take(self) -> list[tuple[str, str, Instance, datetime]]:
        out, self.out = self.out, []
        return out

    def take_emitted(self) -> list[tuple[str, Any, str, datetime]]:
        out, self.emitted = self.emitted, []
        return out

    # --- time -------------------------------------------------------------------------------------------------------------

    def advance(self, to: datetime) -> None:
        """Move the clock and fire what has timed out, earliest first."""
        self._advance(to)
        self._drain("time")

    def _advance(self, to: datetime) -> None:
        self.clock = max(self.clock, to)
        while (due := self.next_timeout()) is not None and due <= self.clock:
            now = []
            while self._due and self._due[0][0] <= self.clock:
                if self._valid(entry := heapq.heappop(self._due)):
                    now.append(entry)
            again = False
            for entry in now:
                if self._valid(entry):
                    again |= self._fire(entry[2], entry[0])
            if not again:
                break

    def _fire(self, instance: Instance, at: datetime) -> bool:
        """Returns whether what is due should be looked through again."""
        if instance.rule.mode != "schedule":
            self._time_out(instance, at, "matcher_timeout")
            return True
        instance.context["ran"] = at
        self._note("schedule", instance, at, "schedule")
        instance.rearm(self.live, self.clock)
        self._arm(instance)
        return instance.rule.catch_up == "all"

    def _time_out(self, instance: Instance, at: datetime, group: str) -> None:
        self._leave(instance)
        self._count(group, instance.rule.name)
        self._note("timeout", instance, at, "timeout", "done")

    # --- events -----------------------------------------------------------------------------------------------------------

    def handle(self, event: Event) -> None:
        self._handle(event)
        self._drain(event.event)

    def _drain(self, cause: str) -> None:
        """Handle what was emitted, and what that leads to."""
        for _ in range(MOST_EMITTED):
            if not self._again:
                return
            self._handle(self._again.popleft())
        raise RuntimeError(f"{cause} led to over {MOST_EMITTED} events")

    def _handle(self, event: Event) -> None:
        self._count("seen", event.event)
        if self.live:
            if abs(self.clock - event.datetime) > MOST_VARIANCE and self.clock.year > 1970:
                event.datetime = self.clock
        elif event.event not in CONTROL:
            self._advance(max(self.clock, event.datetime - TICK))
        handled, late, taken, suppressed = [], [], set(), False
        # Those that wait for the very type come first, then those for any.
        for kind in dict.fromkeys((event.event, ANY)):
            for instance in list(self._watch.get(kind, {}).values()):
                result = instance.handle(event)
                if result & Result.HANDLED:
                    handled.append(instance)
                    taken.add(instance.rule.name)
                    self.wait(instance) if not instance.complete else self._leave(instance)
                    self._count("handled", f"{event.event}|{instance.rule.name}")
                if result & Result.TIMEOUT and not result & Result.HANDLED:
                    late.append(instance)
                if result & Result.SUPPRESS:
                    suppressed = True
                    self._count("suppressed", event.event)
                    break
            if suppressed:
                break
        if not suppressed:
            for rule in self._initial(event.event):
                if rule.name in taken:
                    continue
                fresh = Instance(rule, memory=self.memory)
                result = fresh.handle(event)
                if not result & Result.HANDLED:
                    continue
                handled.append(fresh)
                self._count("init_matcher", rule.name)
                self._count("handled", f"{event.event}|{rule.name}")
                if not fresh.complete:
                    self.wait(fresh)
                if result & Result.SUPPRESS:
                    self._count("suppressed", event.event)
                    break
        if not handled:
            self._count("unhandled", event.event)
        for instance in late:
            self._time_out(instance, event.datetime, "completed_matcher_timeout")
        for instance in handled:
            self._after(instance, event.datetime)

    def _initial(self, kind: str) -> list[Rule]:
        """Rules that an event of a type may begin: those for the very type, then those for any."""
        if kind not in self._begins:
            typed = self._first.get(kind, [])
            self._begins[kind] = typed + [r for r in self._first.get(ANY, []) if all(r is not t for t in typed)]
        return self._begins[kind]

    def _after(self, instance: Instance, at: datetime) -> None:
        """Callbacks come before the next timeout is set."""
        if not instance.complete:
            self._note("progress", instance, at, "progress")
            instance.rearm(self.live, self.clock)
            self._arm(instance)
            return
        if instance.rule.mode == "vef":
            phase = "failed" if instance.context["event"] is None else "passed"
            self._note(phase, instance, at, phase)
        else:
            self._note("complete", instance, at, "complete", "done")
        self._count("completed_matcher", instance.rule.name)

    def go_live(self, now: datetime) -> None:
        """From batch to live: timeouts count from now on, overdue ones fire at once."""
        self.live, self.clock = True, max(self.clock, now)
        for instance in self.waiting:
            instance.rearm(True, now)
            self._arm(instance)
        self.advance(now)
