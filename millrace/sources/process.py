"""A child process as a source: what it writes to its standard output, a JSON-RPC message a line, as rows of ``value``.

``spark.read.format("process")`` runs it to its end in one task, ``spark.readStream`` runs it beside the driver. Options:
``command`` (JSON list), ``env`` (JSON object), ``checkpoint`` (JSON), ``compressed`` (raw deflate), ``most`` (lines of a
batch of the stream), ``replays``. The last checkpoint is in the environment as SOURCE_CHECKPOINT, unless ``env`` has it. A
process that fails is started again from its last checkpoint. One that replays writes the same lines after the same
checkpoint, and those that are known are passed over; of any other every line counts. A stream gives each line once where
the process replays; else a batch that was under way when the driver was lost is read from the process anew. Exit codes 0
and 127 are final. parse_rpc tells the messages apart.
"""

from __future__ import annotations

import json
import logging
import os
import queue
import subprocess
import threading
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from millrace.state import FINAL

log = logging.getLogger(__name__)

CHECKPOINT = "SOURCE_CHECKPOINT"
#: Starts of a process that fails without a line in between.
MOST_STARTS = 10
#: Seconds that a stream waits for the first line of a batch.
WAIT_S = 0.2


def decoded(out, compressed: bool) -> Iterator[str]:
    """Lines of a byte stream, empty ones left out."""
    if not compressed:
        for raw in out:
            if line := raw.decode("utf-8", "replace").rstrip("\r\n"):
                yield line
        return
    inflate, rest = zlib.decompressobj(-15), b""
    while part := out.read1(1 << 16):
        *lines, rest = (rest + inflate.decompress(part)).split(b"\n")
        yield from (line.decode("utf-8", "replace").rstrip("\r") for line in lines if line.strip())
    if rest.strip():
        yield rest.decode("utf-8", "replace")


def checkpoint_of(line: str) -> str | None:
    """The parameters of a checkpoint message, as JSON; None for any other line."""
    try:
        message = json.loads(line)
    except ValueError:
        return None
    return json.dumps(message.get("params")) if isinstance(message, dict) and message.get("method") == "checkpoint" else None


class Run:
    """One source from a place on: a checkpoint, and how many lines after it are known."""

    def __init__(self, options: dict, checkpoint: str | None, since: int = 0):
        self.command = json.loads(options["command"])
        self.env = json.loads(options.get("env", "{}"))
        self.compressed = options.get("compressed", "false").lower() == "true"
        self.replays = options.get("replays", "false").lower() == "true"
        self.checkpoint, self.since = checkpoint, since
        self.child: subprocess.Popen | None = None
        self.stopped = False

    def lines(self) -> Iterator[tuple[str, str | None, int]]:
        """(line, checkpoint, since), the latter two after the line."""
        failed = 0
        while failed < MOST_STARTS and not self.stopped:
            known = {} if self.checkpoint is None else {CHECKPOINT: self.checkpoint}
            env = {**os.environ, **known, **{k: str(v) for k, v in self.env.items()}}
            try:
                self.child = subprocess.Popen(self.command, stdout=subprocess.PIPE, env=env)
            except FileNotFoundError:
                log.error("source %s is not there", self.command[0])
                return
            skip, new = self.since if self.replays else 0, False
            for line in decoded(self.child.stdout, self.compressed):
                if skip:
                    skip -= 1
                    continue
                new, made = True, checkpoint_of(line)
                self.checkpoint, self.since = (self.checkpoint, self.since + 1) if made is None else (made, 0)
                yield line, self.checkpoint, self.since
            code = self.child.wait()
            if code in FINAL or self.stopped:
                return
            failed = 0 if new else failed + 1
            log.warning("source %s ended with %d and is started again", self.command[0], code)
        if not self.stopped:
            raise RuntimeError(f"source {self.command[0]} failed {MOST_STARTS} times")

    def stop(self) -> None:
        self.stopped = True
        if self.child and self.child.poll() is None:
            self.child.terminate()


class ProcessSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "process"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Whole(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))


class _Whole(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [InputPartition(None)]

    def read(self, partition):
        run = Run(self.options, self.options.get("checkpoint"))
        try:
            for line, *_ in run.lines():
                yield (line,)
        finally:
            run.stop()


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.most = options, int(options.get("most", 10_000))
        self.run, self.waiting, self.failed = None, None, None

    def initialOffset(self) -> dict:
        return {"n": 0, "checkpoint": self.options.get("checkpoint"), "since": 0}

    def _start(self, at: dict) -> None:
        self.run = Run(self.options, at["checkpoint"], at["since"])
        self.waiting = queue.Queue(2 * self.most)  # a full one holds the process back

        def pump() -> None:
            try:
                for row in self.run.lines():
                    self.waiting.put(row)
            except RuntimeError as error:
                self.failed = error

        threading.Thread(target=pump, daemon=True).start()

    def read(self, start: dict):
        if self.run is None:
            self._start(start)
        rows, wait = [], WAIT_S
        while len(rows) < self.most:
            try:
                rows.append(self.waiting.get(timeout=wait))
            except queue.Empty:
                break
            wait = 0.01
        if not rows and self.failed:
            raise self.failed
        last = {"checkpoint": rows[-1][1], "since": rows[-1][2]} if rows else {}
        return iter([(line,) for line, *_ in rows]), {**start, **last, "n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict):
        run, n = Run(self.options, start["checkpoint"], start["since"]), end["n"] - start["n"]
        rows = []
        try:
            if n:
                for line, *_ in run.lines():
                    rows.append((line,))
                    if len(rows) == n:
                        break
        finally:
            run.stop()
        return iter(rows)

    def commit(self, end: dict) -> None:
        pass
