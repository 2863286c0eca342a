"""Event sources: tables, newline JSON, JSON-RPC lines, generators; a registry, checkpoints and on-demand runs."""

from __future__ import annotations

import logging
import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from millrace.functions import event_time
from millrace.state import Store

log = logging.getLogger(__name__)

ENVELOPE = "event string, datetime timestamp, received_time timestamp, id string, payload string"
METHODS = ("handle", "checkpoint", "log")


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with ts as a timestamp (UTC)."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def normalise(raw: DataFrame, fixed: tuple[str, ...] = ("event", "datetime", "receivedTime", "id"), missing: Column | None = None) -> DataFrame:
    """Rows with any columns to the event envelope; what isn't fixed goes to the JSON payload."""
    columns = {c: F.col(c) for c in raw.columns}
    kind = dict(raw.dtypes).get("datetime", "string")
    kind = "int" if kind in ("int", "bigint") else "string" if kind == "string" else "timestamp"
    received = columns.get("receivedTime", F.lit(None)).cast("timestamp")
    rest = [columns[c] for c in raw.columns if c not in fixed]
    return raw.select(
        columns["event"].alias("event"),
        event_time(columns.get("datetime", F.lit(None).cast("string")), kind, missing).alias("datetime"),
        received.alias("received_time"),
        columns.get("id", F.lit(None)).cast("string").alias("id"),
        (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("payload"),
    )


def read_ndjson(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def parse_rpc(lines: DataFrame, column: str = "value") -> dict[str, DataFrame]:
    """JSON-RPC lines by method. ``handle`` has the event's JSON; ``rejected`` what has no object as event, an unknown
    method or no JSON at all, with the reason."""
    v = F.try_parse_json(column)
    method = F.try_variant_get(v, "$.method", "string")
    event = F.try_variant_get(v, "$.params.event", "variant")
    is_object = F.coalesce(F.schema_of_variant(event).startswith("OBJECT"), F.lit(False))
    reason = (
        F.when(v.isNull(), "not JSON")
        .when(method.isNull() | ~method.isin(*METHODS), "unknown method")
        .when((method == "handle") & ~is_object, "event is not an object")
    )
    rows = lines.select(F.col(column).alias("line"), v.alias("v"), method.alias("method"), reason.alias("reason"))
    good = rows.where("reason is null")
    params = F.to_json(F.variant_get("v", "$.params", "variant"))
    return {
        "handle": good.where("method = 'handle'").select(F.to_json(F.variant_get("v", "$.params.event", "variant")).alias("event")),
        "checkpoint": good.where("method = 'checkpoint'").select(params.alias("params")),
        "log": good.where("method = 'log'").select(
            *[F.try_variant_get("v", f"$.params.{a}", "string").alias(b) for a, b in (("logLevel", "level"), ("message", "message"), ("context", "context"))]
        ),
        "rejected": rows.where("reason is not null").select("line", "reason"),
    }


def generate(spark: SparkSession, rows: Iterator[dict] | list[dict], schema: str, delay: float = 0) -> DataFrame:
    """A bounded generator as a table; its rows come with seq, and with after_s, the seconds after the first that a delay
    puts them at."""
    if delay < 0:
        raise ValueError("a delay must not be negative")
    made = [{**row, "seq": i, "after_s": i * float(delay)} for i, row in enumerate(rows)]
    return spark.createDataFrame(made, f"{schema}, seq long, after_s double")


def inflated(rows: DataFrame, column: str = "value") -> DataFrame:
    """(value): text of messages in raw deflate, one message a row; null where it is none."""

    def run(batches):
        for batch in batches:
            made = []
            for raw in batch.column(0).to_pylist():
                try:
                    made.append(zlib.decompressobj(-15).decompress(raw).decode() if raw is not None else None)
                except (zlib.error, UnicodeDecodeError):
                    made.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["value"])

    return rows.select(column).mapInArrow(run, "value string")


class CounterSource(DataSource):
    """Rows ('Count', value) for value 1 to ``n``: batch, and as a stream of ``step`` values a batch."""

    @classmethod
    def name(cls) -> str:
        return "counter"

    def schema(self) -> str:
        return "event string, value long"

    def reader(self, schema) -> DataSourceReader:
        return _CounterReader(int(self.options.get("n", 10)))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _CounterStream(int(self.options.get("n", 10)), int(self.options.get("step", 5)))


class _CounterReader(DataSourceReader):
    def __init__(self, n: int):
        self.n = n

    def partitions(self):
        return [InputPartition((a, min(self.n, a + 999))) for a in range(1, self.n + 1, 1000)]

    def read(self, partition):
        a, b = partition.value
        yield from (("Count", x) for x in range(a, b + 1))


class _CounterStream(SimpleDataSourceStreamReader):
    def __init__(self, n: int, step: int):
        self.n, self.step = n, step

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict):
        end = min(self.n, start["at"] + self.step)
        return iter([("Count", x) for x in range(start["at"] + 1, end + 1)]), {"at": end}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([("Count", x) for x in range(start["at"] + 1, end["at"] + 1)])

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Source:
    read: Callable[..., DataFrame]
    env: dict = field(default_factory=dict)
    essential: bool = False
    autostart: bool = True


class SourceRegistry:
    """Named sources: functions of (spark, env, checkpoint) that return tables."""

    def __init__(self, store: Store | None = None):
        """With a store, checkpoints outlive the driver."""
        self.sources: dict[str, Source] = {}
        self.store, self.failed = store, {}
        self.checkpoints: dict[str, object] = (store.load() if store else None) or {}
        self.paused: set[str] = set()

    def pause(self, *names: str) -> None:
        """Leave sources (all without names) out of starts until they are resumed."""
        self.paused |= set(names or self.sources)

    def resume(self, *names: str) -> None:
        self.paused -= set(names or self.sources)

    def register(self, name: str, read: Callable[..., DataFrame], env: dict | None = None, essential: bool = False, autostart: bool = True) -> None:
        self.sources[name] = Source(read, dict(env or {}), essential, autostart)

    def unregister(self, name: str) -> None:
        self.sources.pop(name, None)

    def checkpoint(self, name: str, value) -> None:
        self.checkpoints[name] = value
        if self.store:
            self.store.save(self.checkpoints)

    def run(self, spark: SparkSession, name: str, variables: dict | None = None) -> DataFrame:
        """Run one source on demand; its own settings win over the variables of the run."""
        if name not in self.sources:
            raise KeyError(f"no source {name!r}")
        source = self.sources[name]
        return source.read(spark, {**(variables or {}), **source.env}, self.checkpoints.get(name))

    def start_all(self, spark: SparkSession) -> DataFrame | None:
        """All autostart sources together. An essential source's error stops the start, another's is logged, kept in
        ``failed`` and left out."""
        started, self.failed = None, {}
        for name, source in self.sources.items():
            if not source.autostart or name in self.paused:
                continue
            try:
                made = self.run(spark, name)
            except Exception as error:
                if source.essential:
                    raise
                log.exception("source %s failed", name)
                self.failed[name] = error
                continue
            started = made if started is None else started.unionByName(made, allowMissingColumns=True)
        return started


def resume(events: DataFrame, after: int | None, column: str = "event_id") -> DataFrame:
    """Only what comes after a checkpoint; the filter reaches the scan."""
    return events if after is None else events.where(F.col(column) > after)


def env(name: str, default: str | None = None) -> str:
    value = os.environ.get(name, default)
    if value is None:
        raise KeyError(f"{name} is not set")
    return value
