"""What the driver keeps between runs: saved states, attempts to recover, checkpoints; and when to hold sources back.

States are numbered folders of compressed JSON lines in a shared folder, written by Spark to the end before they count, so
a reader finds the last whole one whatever happened to a later one.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

log = logging.getLogger(__name__)
#: Older states that are kept beside the last one.
KEPT = 2


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self) -> list[int]:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/state-*/_SUCCESS")
        return sorted(int(x.getPath().getParent().getName().rsplit("-", 1)[1]) for x in top.getFileSystem(conf).globStatus(top) or [])

    def save(self, state: dict) -> int:
        numbers = self._numbers()
        number = (numbers[-1] if numbers else 0) + 1
        rows = self.spark.createDataFrame([(json.dumps(state, default=str),)], "value string")
        rows.coalesce(1).write.mode("overwrite").option("compression", "gzip").text(f"{self.path}/state-{number}")
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for old in numbers[: -KEPT or None]:
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/state-{old}")
            folder.getFileSystem(conf).delete(folder, True)
        return number

    def load(self) -> dict | None:
        """The last saved state; None where there is none, an error where it isn't a state."""
        if not (numbers := self._numbers()):
            return None
        rows = self.spark.read.text(f"{self.path}/state-{numbers[-1]}").collect()
        try:
            state = json.loads(rows[0]["value"])
        except (IndexError, ValueError) as error:
            raise ValueError(f"{self.path} holds no state that can be read") from error
        if not isinstance(state, dict):
            raise ValueError(f"{self.path} holds no state that can be read")
        return state


@dataclass
class Recovery:
    """Protection from crashing again and again: at most ``most`` starts after unclean ends, each ``cooldown_s`` after the
    last. A clean stop forgets them."""

    store: Store
    cooldown_s: float = 60.0
    most: int = 3
    clock: Callable[[], float] = time.time

    def begin(self) -> float:
        """Note a start; returns the seconds to wait before it. Raises where there were too many."""
        last = self.store.load() or {"attempts": 0, "at": 0.0}
        now = self.clock()
        if last["attempts"] >= self.most:
            raise RuntimeError(f"{last['attempts']} starts have failed; remove {self.store.path} to try again")
        self.store.save({"attempts": last["attempts"] + 1, "at": now})
        return max(0.0, last["at"] + self.cooldown_s - now) if last["attempts"] else 0.0

    def clean(self) -> None:
        self.store.save({"attempts": 0, "at": self.clock()})


@dataclass
class Backpressure:
    """Whether sources are held back: from ``pause_share`` of memory or ``pause_open`` open actions on, until both are down
    to the lower marks. ``stuck`` tells that they have been held for too long."""

    pause_share: float = 0.5
    resume_share: float = 0.35
    pause_open: int = 30_000
    resume_open: int = 500
    stuck_s: float = 300.0
    since: float | None = None

    def look(self, share: float, n_open: int, now: float) -> bool:
        if self.since is None:
            if share >= self.pause_share or n_open > self.pause_open:
                self.since = now
        elif share <= self.resume_share and n_open < self.resume_open:
            self.since = None
        return self.since is not None

    def stuck(self, now: float) -> bool:
        return self.since is not None and now - self.since >= self.stuck_s

    @staticmethod
    def options(most_files: int | None = None, most_bytes: str | None = None) -> dict[str, str]:
        """The same for a file stream, which takes no more than this in a batch."""
        made = {"maxFilesPerTrigger": most_files, "maxBytesPerTrigger": most_bytes}
        return {k: str(v) for k, v in made.items() if v is not None}


#: Exit codes after which a source isn't started again: done, and not found.
FINAL = (0, 127)


def supervised(run: Callable[[], int], name: str, essential: bool = False, most: int = 10, wait: Callable[[int], None] = lambda n: None) -> str:
    """Run a source, again after each failure. Its end is done, missing or given up; an essential one's end stops the engine,
    which is told by ``stop``."""
    for attempt in range(most):
        try:
            code = run()
        except Exception:
            log.exception("source %s failed, attempt %d", name, attempt + 1)
            code = 1
        if code in FINAL:
            return "stop" if essential else "done" if code == 0 else "missing"
        wait(attempt)
    return "stop" if essential else "given up"


@dataclass
class Metrics:
    """Counts and gauges by name."""

    values: dict[str, float] = field(default_factory=dict)

    def inc(self, name: str, by: float = 1) -> None:
        self.values[name] = self.values.get(name, 0) + by

    def set(self, name: str, value: float) -> None:
        self.values[name] = value

    def snapshot(self) -> dict[str, float]:
        return dict(sorted(self.values.items()))

    def log(self) -> None:
        log.info("metrics %s", json.dumps(self.snapshot()))
