from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace import functions as fn
from millrace.operators import actions, exact, memory, metrics, patterns, temporal
from millrace.operators.fold import Engine, Event
from millrace.operators.rule import Rule, RuleSet
from millrace.runtime import Runtime, State
from millrace.sources import CounterSource, SourceRegistry, generate, load_events, normalise, parse_rpc, resume
from millrace import streaming

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)
S = timedelta(seconds=1)


def at(seconds, event, **data):
    return Event(event, T0 + seconds * S, data.pop("id", None), data)


def phases(engine):
    return [(r, p) for r, p, _, _ in engine.take() if p != "progress"]


def test_timeout_fires_once_and_in_order():
    calls = []
    rule = Rule("t", (("start",), ("never",)), S, callbacks={p: lambda i, p=p: calls.append(p) for p in ("timeout", "done", "complete")})
    engine = Engine([rule])
    engine.handle(at(0, "start"))
    engine.handle(at(1, "other"))  # the clock is a millisecond behind
    assert calls == []
    engine.handle(at(2, "other"))
    engine.handle(at(9, "other"))
    assert calls == ["timeout", "done"]


def test_sequence_is_inclusive_and_fans_out():
    rule = Rule("s", (("a",), ("b",)), 20 * S, ("k",))
    engine = Engine([rule])
    for s, e, k in ((0, "a", 1), (5, "a", 1), (6, "a", 2), (20, "b", 1), (27, "b", 2)):
        engine.handle(at(s, e, k=k))
    assert phases(engine) == [("s", "complete"), ("s", "complete"), ("s", "timeout")]


def test_late_event_times_out_and_starts_anew():
    engine = Engine([Rule("c", (("a",),), S, mode="continuous")], live=True)
    engine.handle(at(0, "a"))
    engine.handle(at(5, "a"))
    assert phases(engine) == [("c", "timeout")] and len(engine.waiting) == 1


def test_same_class_pairs_suppression_and_statistics():
    engine = Engine([Rule("p", (("a",), ("a",))), Rule("q", (("b",),), mode="single", suppress=True), Rule("any", (("*",),), mode="single")])
    for i, e in enumerate("aaaab"):
        engine.handle(at(i, e))
    done = phases(engine)
    assert done.count(("p", "complete")) == 2 and done.count(("any", "complete")) == 4 and ("q", "complete") in done
    assert engine.stats["suppressed", "b"] == 1 and engine.stats["seen", "a"] == 4


def test_keep_last_anchor_and_going_live():
    engine = Engine([Rule("k", (("a",),), mode="continuous", keep_last=3), Rule("w", (("a",),), 3 * S, mode="anchored"),
                     Rule("h", (("a",), ("z",)), S, ignore_timeout_in_batch=True)])
    for s in range(6):
        engine.handle(at(s, "a"))
    held = next(i for i in engine.waiting if i.rule.name == "k")
    assert [e.datetime for e in held.chain] == [T0 + s * S for s in (3, 4, 5)] and held.seen == 6
    assert ("w", "timeout") in phases(engine)
    engine.go_live(T0 + 100 * S)
    assert phases(engine).count(("h", "timeout")) == 6


def test_rules_are_checked():
    with pytest.raises(ValueError):
        Rule("x", (("a",), ("b",)), mode="single")
    with pytest.raises(ValueError):
        Rule("x", ())
    rules = RuleSet([Rule("x", (("a",),))])
    with pytest.raises(ValueError):
        rules.add(Rule("x", (("b",),)))
    with pytest.raises(TypeError):
        rules.add("Missing")


def both_tiers(spark, rule):
    e = load_events(spark, SF)
    s = patterns.sequence(e, rule)
    n = len(rule.steps)
    end = e.agg(F.max("ts")).first()[0] - timedelta(milliseconds=1)
    closed = {(("complete", r["id1"], r[f"id{n}"]) if r[f"id{n}"] is not None else ("timeout", r["id1"])) for r in s.collect() if r[f"id{n}"] is not None or r["deadline"] <= end}
    folded = {(("complete", r.first_id, r.last_id) if r.phase == "complete" else ("timeout", r.first_id)) for r in exact.run(e, [rule], "user_id").collect()}
    return closed, folded


@pytest.mark.parametrize("steps,hours", [((("signup",), ("purchase",)), 6), ((("signup",), ("click", "view")), 24), ((("signup",), ("click",), ("purchase",)), 24), ((("error", "view"), ("click",)), 1)])
def test_windows_give_what_the_engine_gives(spark, steps, hours):
    closed, folded = both_tiers(spark, Rule("r", steps, timedelta(hours=hours), ("user_id",)))
    assert closed == folded and closed


def test_closed_form_refuses_overlap(spark):
    with pytest.raises(ValueError):
        patterns.sequence(load_events(spark, SF), Rule("r", (("a",), ("a", "b")), S, ("user_id",)))


def write_batches(spark, folder, parts=3):
    e = load_events(spark, SF).orderBy("ts", "event_id").toPandas()
    step = -(-len(e) // parts)
    for i in range(parts):
        spark.createDataFrame(e.iloc[i * step : (i + 1) * step]).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(load_events(spark, SF).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rules = [Rule("seq", (("signup",), ("purchase",)), timedelta(hours=6), ("user_id",)), Rule("overlap", (("signup",), ("purchase", "signup")), timedelta(hours=6), ("user_id",))]
    runtime = Runtime(spark, rules, checkpoint=str(tmp_path / "cp"))
    stream = write_batches(spark, tmp_path / "in")
    got = []
    runtime.state = State.RUNNING
    query = runtime.run_stream(stream, "user_id", lambda batch, _: got.extend(batch.collect()), once=True)
    query.awaitTermination(120)
    assert query.exception() is None
    e = load_events(spark, SF)
    want = {(r.rule, r.phase, r.first_id, r.last_id if r.phase == "complete" else 0) for r in exact.run(e, rules, "user_id", flush=False).collect()}
    seen = {(r.rule, r.phase, r.first_id, r.last_id if r.phase == "complete" else 0) for r in got}
    flushed = {(r.rule, r.phase, r.first_id, r.last_id if r.phase == "complete" else 0) for r in exact.run(e, rules, "user_id").collect()}
    assert {x for x in want if x[1] == "complete"} == {x for x in seen if x[1] == "complete"}
    assert want <= seen <= flushed and len(got) == len(seen)
    runtime.stop()
    assert runtime.status()["state"] == "stopped"


def test_saved_state_keeps_timeouts_and_leaves_unknown_rules():
    rules = [Rule("a", (("x",), ("y",)), S), Rule("gone", (("x",), ("z",)))]
    engine = Engine(rules)
    engine.handle(at(0, "x"))
    back = streaming.restore(streaming.save(engine), rules[:1])
    assert [(i.rule.name, i.timeout) for i in back.waiting] == [("a", T0 + S)]


def test_runtime_batch_uses_both_tiers(spark):
    e = load_events(spark, SF)
    rules = [Rule("seq", (("signup",), ("purchase",)), timedelta(hours=6), ("user_id",)), Rule("pair", (("error",), ("error",)), None, ("user_id",))]
    got = {(r.rule, r.phase, r.first_id) for r in Runtime(spark, rules).run_batch(e, "user_id").collect()}
    assert got == {(r.rule, r.phase, r.first_id) for r in exact.run(e, rules, "user_id").collect()}


def test_ranges_numbers_and_texts(spark):
    rows = spark.createDataFrame([("5",), (" 1e1 ",), ("NaN",), ("12d",), ("0x1A",), (None,), ("20",)], "v string")
    got = [tuple(r) for r in rows.select(fn.range_inclusive(F.col("v"), 20, 5), fn.range_exclusive(F.col("v"), 20, 5)).collect()]
    assert got == [(True, False), (True, True), (False, False), (False, False), (False, False), (False, False), (True, False)]
    row = spark.range(1).select(
        fn.human_bytes(F.lit(1536)), fn.human_duration(F.lit(90061)), fn.memory_size(F.lit("512M")), fn.memory_size(F.lit("x")),
        fn.interpolate(F.lit("a {b} {c}"), {"b": F.lit(1)}), fn.rfc3339(F.expr("timestamp'2024-01-02 03:04:05.678999'")),
    ).first()
    assert tuple(row) == ("1.5 KB", "1d 1h 1m 1s", 512 << 20, None, "a 1 {c}", "2024-01-02T03:04:05.678+00:00")
    assert fn.period("PT20S") == 20 * S and fn.period("PT0S") is None and fn.period("P1DT2H") == timedelta(days=1, hours=2)
    with pytest.raises(ValueError):
        fn.period("P1M")


def test_memory(spark):
    e = lambda *r: memory.writes(spark.createDataFrame(r, memory.WRITES))
    log = e(("s", "42", "cooling", T0, 0, True, 1), ("s", "42", "off", T0 + 5 * S, 10, False, 2), ("w", "t", "25", T0, -1, True, 3), ("w", "h", "9", T0, 300, True, 4), ("w", "z", None, T0 + S, 0, True, 5))
    now = lambda s: F.lit(T0 + s * S)
    live = lambda s: {(r.ns, r.key): r.value for r in memory.snapshot(log, now(s)).collect()}
    assert live(14) == {("s", "42"): "off", ("w", "h"): "9"} and live(15) == {("w", "h"): "9"} and live(300) == {}
    assert {r.ns: r.purged for r in memory.purge_count(log, now(15)).collect()} == {"s": 1, "w": 1}
    reads = spark.createDataFrame([("42", T0 + k * S, 100 + k) for k in (0, 4, 6, 15)] + [("none", T0, 1)], "k string, ts timestamp, event_id long")
    got = {(r.k, r.event_id): r.memory_value for r in memory.get(reads, log, "k").collect()}
    assert got == {("42", 100): "cooling", ("42", 104): "cooling", ("42", 106): "off", ("42", 115): None, ("none", 1): None}
    assert memory.has(reads, log, "k").count() == 3


def test_memory_is_saved_and_loaded(spark, tmp_path):
    log = memory.preload(spark, lambda: [("s", "a", "1", T0, 0, True, 1), ("s", "b", "2", T0, 0, False, 2), ("s", "c", "3", T0, 9, True, 3)])
    memory.persist(log, F.lit(T0), str(tmp_path / "m"))
    keys = lambda s: {r.key for r in memory.load(spark, str(tmp_path / "m"), F.lit(T0 + s * S)).collect()}
    assert keys(0) == {"a", "c"} and keys(9) == {"a"}
    assert memory.load(spark, str(tmp_path / "none"), F.lit(T0)).count() == 0
    with pytest.raises(TypeError):
        memory.preload(spark, lambda: "no list")


def test_actions(spark):
    registry = actions.Registry()
    registry.register("t", lambda test: None, {"type": "object", "properties": {"test": {"type": "boolean"}}, "required": ["test"], "additionalProperties": False})

    def fails():
        raise RuntimeError("no")

    registry.register("f", fails)
    rows = spark.createDataFrame([("t", '{"test": true}'), ("t", '{"test": "test"}'), ("t", '{"abc": true}'), ("u", "{}"), ("f", "{}"), ("t", "not json")], "cmd string, vars string")
    dispatched = registry.dispatch(rows)
    assert sorted((r.cmd, r.code) for r in dispatched.collect() if r.code) == [("t", -32602)] * 3 + [("u", -1)]
    done = {(r.cmd, r.status, r.message) for r in registry.run_batch(dispatched).collect()}
    assert done == {("t", "completed", None), ("f", "failed", "no")}
    status = spark.createDataFrame([("a", "inflight", None), ("b", "errored", -1), ("c", "errored", -32603), ("d", "errored", 7), ("e", "completed", None)], "cmd string, status string, code int")
    assert sorted((r.cmd, r.code) for r in actions.to_retry(status).collect()) == [("a", 2), ("c", -32603), ("d", 7)]
    assert sum(r.n_inflight for r in actions.inflight(status).collect()) == 1


def test_sources(spark):
    lines = ['{"jsonrpc":"2.0","method":"handle","params":{"event":{"event":"A","v":1}}}', '{"method":"handle","params":{"event":"x"}}', '{"method":"nope"}', "garbage",
             '{"method":"checkpoint","params":{"at":7}}', '{"method":"log","params":{"logLevel":"info","message":"m","context":{}}}']
    parsed = parse_rpc(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r.event for r in parsed["handle"].collect()] == ['{"event":"A","v":1}'] and parsed["checkpoint"].first().params == '{"at":7}'
    assert {r.reason for r in parsed["rejected"].collect()} == {"event is not an object", "unknown method", "not JSON"} and parsed["log"].first().level == "info"
    registry = SourceRegistry()
    registry.register("a", lambda s, env, cp: generate(s, [{"event": env["x"]}], "event string"), {"x": "own"})
    registry.register("b", lambda s, env, cp: 1 / 0)
    registry.register("c", lambda s, env, cp: s.range(1), autostart=False)
    assert registry.run(spark, "a", {"x": "var", "y": 1}).first().event == "own" and registry.start_all(spark).count() == 1
    registry.register("b", lambda s, env, cp: 1 / 0, essential=True)
    with pytest.raises(ZeroDivisionError):
        registry.start_all(spark)
    registry.unregister("b")
    with pytest.raises(KeyError):
        registry.run(spark, "b")
    spark.dataSource.register(CounterSource)
    assert [r.value for r in spark.read.format("counter").option("n", 10).load().orderBy("value").collect()] == list(range(1, 11))
    raw = spark.createDataFrame([("A", "2021-06-01T10:00:00+11:00", 5), ("B", None, 6)], "event string, datetime string, orderid int")
    rows = normalise(raw, missing=F.lit(T0)).orderBy("event").collect()
    assert rows[0].datetime == datetime(2021, 5, 31, 23) and rows[1].datetime == T0 and rows[0].payload == '{"orderid":5}'
    assert resume(load_events(spark, SF), None).count() == load_events(spark, SF).count()


def test_schedules(spark):
    bounds = spark.createDataFrame([(T0 + 30 * S, T0 + timedelta(minutes=3))], "start timestamp, stop timestamp")
    assert [r.tick for r in temporal.cron_ticks(bounds, "*/1 * * * *").orderBy("tick").collect()] == [T0 + timedelta(minutes=m) for m in (1, 2, 3)]
    wide = spark.createDataFrame([(T0, T0 + timedelta(days=20))], "start timestamp, stop timestamp")
    for text in ("0 12 1,15 * *", "30 6 13 * fri", "5-20/5 3 * jan-mar mon", "@weekly"):
        cron = temporal.Cron.parse(text)
        want = [t for m in range(1, 20 * 1440 + 1) if cron.hit(t := T0 + timedelta(minutes=m))]
        assert [r.tick for r in temporal.cron_ticks(wide, text).orderBy("tick").collect()] == want and want
    for bad in ("* * *", "61 * * * *", "@never"):
        with pytest.raises(ValueError):
            temporal.Cron.parse(bad)
    beats = temporal.heartbeats(bounds, 60, 10).collect()
    assert [(r.seq, r.runtime_us) for r in beats] == [(0, 70_000_000), (1, 130_000_000)]


def test_metrics(spark):
    rows = spark.createDataFrame([(x,) for x in (1.0, 10.0, 11.0, 500.0)], "v double")
    assert {r.bucket: r.n for r in metrics.histogram(rows, F.col("v"), [100, 10]).collect()} == {"10": 2, "100": 1, "+Inf": 1}
    assert metrics.recent(load_events(spark, SF), 5).count() == 5


def test_runtime_states():
    runtime = Runtime(None)
    with pytest.raises(RuntimeError):
        runtime.move(State.STOPPED)
    for to in (State.RECOVERY, State.RUNNING, State.STOPPING, State.STOPPED):
        runtime.move(to)
    assert pd.notna(runtime.state.value)


def test_dedupe_matchers_is_registered(spark):
    from millrace.plans import catalogue

    folder, want = "/root/testdata/sf0.001", {}
    for r in spark.read.parquet(f"{folder}/events.parquet").orderBy("ts", "event_id").collect():
        first, _, n = want.get(r.event_type, (r.event_id, None, 0))
        want[r.event_type] = (first, r.event_id, n + 1)
    got = catalogue.QUERIES["dedupe_matchers"](spark, folder).collect()
    assert {r.event_type: (r.first_id, r.last_id, r.n_events) for r in got} == want and "dedupe_matchers" in catalogue.ORACLES
