"""Actions: a registry of sinks, parameter schemas, dispatch, outcomes and retries."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDEFINED, INVALID_PARAMS, INTERNAL_ERROR, INTERRUPTED = -1, -32602, -32603, 2


@dataclass(frozen=True)
class Action:
    name: str
    run: Callable | None = None
    schema: dict | None = None


class Registry:
    def __init__(self):
        self.actions: dict[str, Action] = {}

    def register(self, name: str, run: Callable | None = None, schema: dict | None = None) -> None:
        self.actions[name] = Action(name, run, schema)

    def dispatch(self, actions: DataFrame, cmd: str = "cmd", params: str = "vars") -> DataFrame:
        """Rows with ``code`` and ``status``: undefined commands and invalid parameters are errored, others ready to run."""
        known = F.col(cmd).isin(sorted(self.actions)) if self.actions else F.lit(False)
        invalid = F.lit(False)
        for a in self.actions.values():
            if a.schema:
                invalid = invalid | ((F.col(cmd) == a.name) & ~valid(F.col(params), a.schema))
        code = F.when(~F.coalesce(known, F.lit(False)), UNDEFINED).when(invalid, INVALID_PARAMS)
        return actions.withColumn("code", code).withColumn("status", F.when(code.isNull(), "ready").otherwise("errored"))

    def run_batch(self, ready: DataFrame, batch_id: int = 0) -> DataFrame:
        """Run ready actions where they are, in partitions; returns them with status completed or failed.

        An action is a function, a class (made once in a partition) or a Process (one child for a partition).
        """
        runs = {a.name: a.run for a in self.actions.values() if a.run}

        def call(batches):
            made = {}
            try:
                for rows in batches:
                    status, code, message = [], [], []
                    for cmd, params in zip(rows["cmd"], rows["vars"], strict=True):
                        try:
                            if cmd not in made:
                                made[cmd] = runs[cmd].start() if isinstance(runs[cmd], Process) else runs[cmd]() if isinstance(runs[cmd], type) else runs[cmd]
                            made[cmd](**json.loads(params or "{}"))
                            status.append("completed"), code.append(None), message.append(None)
                        except Exception as error:  # an action's failure is a result
                            if isinstance(runs.get(cmd), Process) and cmd in made and not made[cmd].alive:
                                made.pop(cmd).stop()  # the next action gets a new child
                            status.append("failed"), code.append(getattr(error, "code", INTERNAL_ERROR)), message.append(str(error))
                    yield rows.assign(status=status, code=code, message=message).astype({"code": "Int32"})
            finally:
                for child in made.values():
                    if isinstance(child, Child):
                        child.stop()

        read = ready.where("status = 'ready'").select("cmd", "vars")
        return read.mapInPandas(call, "cmd string, vars string, status string, code int, message string")

    def sink(self, path: str):
        """For foreachBatch: dispatches a batch of (cmd, vars), runs what is ready and appends the outcome of every action to
        a status table. A batch that comes again replaces its own rows."""

        def write(batch: DataFrame, batch_id: int) -> None:
            dispatched = self.dispatch(batch)
            errored = dispatched.where("status = 'errored'").select("cmd", "vars", "status", "code", F.lit(None).cast("string").alias("message"))
            done = self.run_batch(dispatched, batch_id).unionByName(errored)
            done.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

        return write


class ActionError(RuntimeError):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Process:
    """A command that answers JSON-RPC requests (method run), a line each, on its standard output."""

    command: tuple[str, ...]

    def start(self) -> Child:
        return Child(self.command)


class Child:
    def __init__(self, command: tuple[str, ...]):
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True)
        self.next = 0

    @property
    def alive(self) -> bool:
        return self.process.poll() is None

    def __call__(self, **params):
        self.next += 1
        request = {"jsonrpc": "2.0", "id": self.next, "method": "run", "params": params}
        try:
            self.process.stdin.write(json.dumps(request) + "\n")
            self.process.stdin.flush()
        except OSError as error:
            raise ActionError(INTERRUPTED, "the process has ended") from error
        for line in self.process.stdout:
            answer = json.loads(line)
            if answer.get("id") == self.next:
                if "error" in answer:
                    raise ActionError(int(answer["error"].get("code", INTERNAL_ERROR)), str(answer["error"].get("message")))
                return answer.get("result")
        self.process.wait()
        raise ActionError(INTERRUPTED, "the process has ended")

    def stop(self) -> None:
        self.process.stdin.close()
        try:
            self.process.wait(10)
        except subprocess.TimeoutExpired:
            self.process.kill()


def valid(params: Column, schema: dict) -> Column:
    """A JSON-schema subset on JSON text: type, required, properties.type, additionalProperties, enum, minimum, maximum."""
    variant = F.try_parse_json(params)
    ok = variant.isNotNull()
    if schema.get("type") == "object":
        ok = ok & F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
    keys = F.json_object_keys(params)
    for name in schema.get("required", []):
        ok = ok & F.coalesce(F.array_contains(keys, name), F.lit(False))
    kinds = {"boolean": "BOOLEAN", "string": "STRING", "integer": "BIGINT|DECIMAL\\(\\d+,0\\)", "number": "BIGINT|DOUBLE|DECIMAL.*", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}
    for name, spec in schema.get("properties", {}).items():
        there = F.coalesce(F.array_contains(keys, name), F.lit(False))
        value = F.try_variant_get(variant, f"$.{name}", "variant")
        good = F.lit(True)
        if kind := spec.get("type"):
            good = good & F.coalesce(F.schema_of_variant(value).rlike(f"^({kinds[kind]})$"), F.lit(False))
        number = F.try_variant_get(variant, f"$.{name}", "double")
        if "minimum" in spec:
            good = good & F.coalesce(number >= spec["minimum"], F.lit(False))
        if "maximum" in spec:
            good = good & F.coalesce(number <= spec["maximum"], F.lit(False))
        if "enum" in spec:
            good = good & F.coalesce(F.try_variant_get(variant, f"$.{name}", "string").isin([str(x) for x in spec["enum"]]), F.lit(False))
        ok = ok & (~there | good)
    if schema.get("additionalProperties") is False:
        allowed = F.array(*[F.lit(n) for n in schema.get("properties", {})]) if schema.get("properties") else F.array().cast("array<string>")
        ok = ok & F.coalesce(F.size(F.array_except(keys, allowed)) == 0, F.lit(False))
    return F.coalesce(ok, F.lit(False))


def to_retry(status: DataFrame) -> DataFrame:
    """Errored actions to run again at start: those in flight at the end (as INTERRUPTED), and all errors but those of
    negative code other than INTERNAL_ERROR."""
    code = F.when(F.col("status") == "inflight", INTERRUPTED).otherwise(F.col("code"))
    open_ones = status.withColumn("code", code).where("status in ('inflight', 'errored', 'failed')")
    return open_ones.where((F.col("code") >= 0) | (F.col("code") == INTERNAL_ERROR))


def inflight(status: DataFrame) -> DataFrame:
    return status.groupBy("cmd").agg(F.count_if(F.col("status") == "inflight").alias("n_inflight"))
