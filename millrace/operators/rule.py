"""Rules as data: what both the compiler and the exact engine read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import timedelta
from enum import IntFlag

ANY = "*"
START, RESTORED, STOP, HEARTBEAT = CONTROL = ("engine:start", "engine:restored", "engine:stop", "engine:heartbeat")
MODES = ("single", "continuous", "sequence", "anchored", "vef", "schedule")


class Result(IntFlag):
    HANDLED = 1
    SKIPPED = 2
    SUPPRESS = 4
    TIMEOUT = 8


@dataclass(frozen=True)
class Rule:
    """An ordered sequence of steps, each a set of event types of which one must come.

    ``mode`` is single (one event, never times out), continuous (absorbs every matching event, never completes),
    sequence, anchored (continuous, timeout counted from the first event), vef (single; the event goes through ``stages``
    and is suppressed where one gives None) or schedule (ticks of ``schedule`` between the engine's start and stop).
    ``keys`` are the columns that correlate events. What only the exact engine can run: ``accept(event, instance)``, a
    further predicate; ``handler(event, instance)``, which decides about the event itself and returns Result flags;
    ``timeout_at(instance, live)``, which sets the next timeout; ``callbacks`` by phase, which may return what the engine is
    to emit. ``catch_up`` is all or one_per_event: how many ticks past events let a schedule fire at once.
    """

    name: str
    steps: tuple[tuple[str, ...], ...]
    timeout: timedelta | None = None
    keys: tuple[str, ...] = ()
    mode: str = "sequence"
    accept: Callable | None = None
    suppress: bool = False
    keep_last: int | None = None
    ignore_timeout_in_batch: bool = False
    callbacks: dict[str, Callable] = field(default_factory=dict)
    stages: tuple[Callable, ...] = ()
    handler: Callable | None = None
    timeout_at: Callable | None = None
    schedule: str | None = None
    zone: str = "UTC"
    catch_up: str = "all"

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")
        if not self.steps or any(not s for s in self.steps):
            raise ValueError("a rule needs steps, and each step a type")
        if self.mode != "sequence" and len(self.steps) != 1:
            raise ValueError(f"a {self.mode} rule has exactly one step")
        if self.keep_last is not None and self.keep_last < 0:
            raise ValueError("keep_last must not be negative")
        if (self.mode == "schedule") != (self.schedule is not None) or (self.mode == "vef") != bool(self.stages):
            raise ValueError("a schedule needs its times, and validate, enrich and filter their stages")
        if self.catch_up not in ("all", "one_per_event"):
            raise ValueError(f"unknown catch-up {self.catch_up!r}")
        if self.mode in ("single", "vef"):
            object.__setattr__(self, "timeout", None)

    @property
    def types(self) -> set[str]:
        return {t for s in self.steps for t in s}

    @property
    def closed_form(self) -> bool:
        """Whether the compiler's windows give exactly what the engine gives."""
        first, rest = set(self.steps[0]), {t for s in self.steps[1:] for t in s}
        if self.handler or self.timeout_at or self.callbacks or self.mode in ("vef", "schedule"):
            return False
        return self.accept is None and not self.suppress and not (first & rest) and ANY not in first | rest or self.mode == "single"


def validate_enrich_filter(name: str, types: tuple[str, ...], validate: Callable, enrich: Callable, keep: Callable, **callbacks) -> Rule:
    """Functions of an event that return one, or None to reject it; ``callbacks`` are passed and failed."""
    return Rule(name, (types,), mode="vef", stages=(validate, enrich, keep), callbacks=callbacks)


def on_schedule(name: str, do: Callable, schedule: str, zone: str = "UTC", catch_up: str = "all") -> Rule:
    """``do(time)`` at each tick; what it returns is emitted."""
    return Rule(name, ((START, RESTORED),), mode="schedule", schedule=schedule, zone=zone, catch_up=catch_up, callbacks={"schedule": do})


def on_startup(name: str, do: Callable) -> Rule:
    return Rule(name, ((START, RESTORED),), mode="single", callbacks={"complete": lambda i: do(i.first)})


def on_shutdown(name: str, do: Callable) -> Rule:
    return Rule(name, ((STOP,),), mode="single", callbacks={"complete": lambda i: do(i.first)})


def on_heartbeat(name: str, do: Callable) -> Rule:
    return Rule(name, ((HEARTBEAT,),), mode="single", callbacks={"complete": lambda i: do(i.first)})


class RuleSet:
    """Rules in the order of their registration."""

    def __init__(self, rules: list[Rule] = ()):
        self.rules: list[Rule] = []
        for rule in rules:
            self.add(rule)

    def add(self, rule: Rule) -> None:
        if isinstance(rule, tuple):  # a function or class that makes a rule, with its arguments
            rule = rule[0](*rule[1:])
        if not isinstance(rule, Rule):
            raise TypeError(f"not a rule: {rule!r}")
        if any(r.name == rule.name for r in self.rules):
            raise ValueError(f"a rule named {rule.name!r} is already registered")
        self.rules.append(rule)

    def types(self) -> set[str]:
        return set().union(*[r.types for r in self.rules]) if self.rules else set()
