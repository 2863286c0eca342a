import random
import sys
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import exact, metrics, patterns
from millrace.operators.actions import Process, Registry
from millrace.operators.fold import Action, Engine, Event, MemoryWrite, SourceRun
from millrace.operators.rule import HEARTBEAT, START, STOP, Result, Rule, RuleSet, on_heartbeat, on_schedule, on_shutdown, on_startup, validate_enrich_filter
from millrace.operators.temporal import Cron
from millrace.runtime import Driver, Runtime
from millrace.sources import SourceRegistry, generate, inflated, load_events
from millrace.state import Backpressure, Metrics, Recovery, Store, supervised

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)
S = timedelta(seconds=1)


def at(seconds, event, **data):
    return Event(event, T0 + seconds * S, data.pop("id", None), data)


def test_emitted_events_come_back_in_after_the_one_at_hand():
    seen = []
    first = Rule("first", (("a",),), mode="single", callbacks={"complete": lambda i: [Event("b", i.first), Action("go", {"x": 1}), SourceRun("more"), MemoryWrite("n", "k", 7, 10)]})
    watch = Rule("watch", (("*",),), mode="single", callbacks={"complete": lambda i: seen.append(i.chain[0].event)})
    driver = Driver([first, watch])
    driver.queue(at(0, "a"), at(1, "c"))
    assert [(k, r) for k, _, r, _ in driver.run()] == [(k, "first") for k in ("event", "action", "source", "memory")]
    assert seen == ["a", "b", "c"] and driver.engine.memory.get("n", "k", T0) == 7 and not driver.engine.memory.has("n", "k", T0 + 10 * S)
    assert driver.engine.memory.all("n", T0) == {"k": 7} and driver.engine.memory.purge(T0 + 10 * S) == 1
    assert driver.engine.stats["emit_event", "b"] == driver.engine.stats["emit_action", "go"] == 1
    endless = Engine([Rule("loop", (("a",),), mode="single", callbacks={"complete": lambda i: Event("a", i.first)})])
    with pytest.raises(RuntimeError):
        endless.handle(at(0, "a"))


def test_own_kinds_and_errors_of_callbacks():
    class Note:
        pass

    engine = Engine([Rule("n", (("a",),), mode="single", callbacks={"complete": lambda i: Note()})])
    with pytest.raises(TypeError):
        engine.handle(at(0, "a"))
    with pytest.raises(ValueError):
        engine.add_emit("two words", Note)
    with pytest.raises(TypeError):
        engine.add_emit("note", "Note")
    engine.add_emit("note", Note)
    engine.handle(at(1, "a"))
    assert engine.take_emitted()[0][0] == "note"
    with pytest.raises(ZeroDivisionError):
        Engine([Rule("bad", (("a",),), mode="single", callbacks={"complete": lambda i: 1 / 0})]).handle(at(0, "a"))


def test_validate_enrich_filter_suppresses_what_it_rejects():
    got = []
    check = validate_enrich_filter(
        "check", ("a",), lambda e: e if "v" in e.data else None, lambda e: Event(e.event, e.datetime, e.id, {**e.data, "w": 2 * e.data["v"]}), lambda e: e if e.data["w"] > 4 else None,
        passed=lambda i: got.append(i.context["event"].data), failed=lambda i: got.append(None),
    )
    engine = Engine([check, Rule("later", (("a",),), mode="single")])
    for k, data in enumerate(({"v": 3}, {}, {"v": 1})):
        engine.handle(at(k, "a", **data))
    assert got == [{"v": 3, "w": 6}, None, None]
    assert [(r, p) for r, p, _, _ in engine.take()] == [("check", "passed"), ("later", "complete"), ("check", "failed"), ("check", "failed")]
    assert engine.stats["suppressed", "a"] == 2


def test_schedules_from_start_to_stop():
    for catch_up, want in (("all", [1, 2, 3, 4]), ("one_per_event", [1, 2, 3])):
        ticks = []
        engine = Engine([on_schedule("s", lambda t: ticks.append((t - T0).seconds // 60), "* * * * *", catch_up=catch_up)])
        engine.handle(at(0, START))
        engine.handle(at(190, "x"))
        assert ticks == (want[:3] if catch_up == "all" else want[:1])
        engine.handle(at(250, "x"))
        engine.handle(at(251, "x"))
        assert ticks == want
        engine.handle(at(252, STOP))
        engine.handle(at(999, "x"))
        assert ticks == want and not engine.waiting
    calls = []
    engine = Engine([on_startup("up", lambda t: calls.append("up")), on_shutdown("down", lambda t: calls.append("down")), on_heartbeat("beat", lambda t: Event("pulse", t))])
    for k, e in enumerate((START, HEARTBEAT, "x", STOP)):
        engine.handle(at(k, e))
    assert calls == ["up", "down"] and engine.stats["seen", "pulse"] == 1


def test_next_ticks_equal_the_minutes_that_match():
    rng = random.Random(3)
    for text, zone in (("*/7 3,15 * * *", "UTC"), ("30 6 13 * fri", "UTC"), ("15 9 * * mon-fri", "Australia/Sydney"), ("0 0 1 * *", "America/New_York")):
        cron = Cron.parse(text)
        from zoneinfo import ZoneInfo
        for _ in range(3):
            start = T0 + timedelta(minutes=rng.randint(0, 400 * 1440), seconds=rng.randint(0, 59))
            t = start.replace(second=0)
            while True:
                t += timedelta(minutes=1)
                if cron.hit(t.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone)).replace(tzinfo=None)):
                    break
            assert cron.next_after(start, zone) == t
    assert Cron.parse("0 0 31 2 *").next_after(T0) is None


def test_typed_rules_come_before_wildcards():
    engine = Engine([Rule("wild", (("*",),), mode="single", suppress=True), Rule("typed", (("a",),), mode="single")])
    engine.handle(at(0, "a"))
    assert [r for r, *_ in engine.take()] == ["typed", "wild"]
    assert engine.stats["handled", "a|typed"] == 1 and engine.stats["completed_matcher", "wild"] == 1


def test_own_handlers_timeouts_and_counters():
    def third(event, instance):
        if event.event != "a":
            return Result.SKIPPED
        instance.context["n"] = instance.context.get("n", 0) + 1
        instance.consume(event)
        return Result.HANDLED

    engine = Engine([Rule("own", (("a",), ("a",), ("a",)), handler=third, timeout_at=lambda i, live: i.first + 3 * S)])
    for k in range(2):
        engine.handle(at(k, "a"))
    assert engine.next_timeout() == T0 + 3 * S and engine.waiting[0].context == {"n": 2}
    engine.handle(at(9, "b"))
    assert engine.stats["matcher_timeout", "own"] == 1 and engine.stats["unhandled", "b"] == 1
    late = Engine([Rule("c", (("a",),), S, mode="continuous")], live=True)
    late.handle(at(0, "a")), late.handle(at(5, "a"))
    assert late.stats["completed_matcher_timeout", "c"] == 1


def test_callbacks_come_before_the_next_timeout_is_set():
    seen = []
    rule = Rule("k", (("a",),), 5 * S, mode="continuous", keep_last=2, callbacks={"progress": lambda i: seen.append((len(i.chain), i.timeout))})
    engine = Engine([rule])
    for k in range(4):
        engine.handle(at(k, "a"))
    assert seen == [(1, None), (2, T0 + 5 * S), (3, T0 + 6 * S), (3, T0 + 7 * S)]


def test_many_open_instances_cost_what_an_event_concerns():
    engine = Engine([Rule("s", (("a",), ("b",)), timedelta(days=1), ("k",))])
    for k in range(20_000):
        engine.handle(at(k / 100, "a", k=k))
    for k in range(5_000):
        engine.handle(at(300, "other"))
    assert len(engine.waiting) == 20_000 and engine.stats["unhandled", "other"] == 5_000


def test_rules_register_as_makers_and_refuse_what_lacks():
    rules = RuleSet([(Rule, "x", (("a",),))])
    assert rules.rules[0].name == "x"
    for bad in ({"mode": "vef"}, {"mode": "schedule"}, {"schedule": "* * * * *"}, {"catch_up": "some"}):
        with pytest.raises(ValueError):
            Rule("y", (("a",),), **bad)


def test_exact_engine_over_tables(spark):
    events = load_events(spark, SF)
    rules = [Rule("pair", (("error",), ("click",)), timedelta(hours=9), ("user_id",)), Rule("all", (("view",),), timedelta(hours=30), ("user_id",), mode="continuous", keep_last=2)]
    want, end = [], max(r.ts for r in events.collect()) - timedelta(milliseconds=1)
    by = {}
    for r in events.orderBy("ts", "event_id").collect():
        if r.event_type in ("error", "click", "view"):
            by.setdefault(r.user_id, []).append(Event(r.event_type, r.ts, r.event_id, {"user_id": r.user_id}))
    for own in by.values():
        engine = Engine(rules)
        for e in own:
            engine.handle(e)
        engine.advance(end)
        want += exact.outcome_rows(engine, ("complete", "timeout"))
    got = [tuple(r) for r in exact.run(events, rules, "user_id").collect()]
    assert sorted(got) == sorted(want) and got
    assert exact.run(events.limit(0), rules, "user_id").count() == 0
    assert Runtime(spark, []).run_batch(events, "user_id").count() == 0


def test_anchored_windows_equal_a_plain_walk(spark):
    events, length = load_events(spark, SF), timedelta(hours=24)
    want, begun = {}, {}
    for r in events.where("event_type in ('click', 'view')").orderBy("ts").collect():
        if r.user_id not in begun or r.ts > begun[r.user_id] + length:
            begun[r.user_id] = r.ts
        k = (r.user_id, begun[r.user_id])
        want[k] = want.get(k, 0) + 1
    assert {(r.user_id, r.first_ts): r.n_events for r in patterns.anchored(events, {"click", "view"}, "user_id", length).collect()} == want


def test_actions_of_all_forms_and_the_status_table(spark, tmp_path):
    class Count:
        def __init__(self):
            self.n = 0

        def __call__(self, **_):
            self.n += 1
            if self.n > 2:
                raise RuntimeError("third")

    child = (
        "import sys, json\n"
        "for line in sys.stdin:\n"
        "    r = json.loads(line)\n"
        "    if r['params'].get('die'): sys.exit(3)\n"
        "    a = {'error': {'code': 42, 'message': 'no'}} if r['params'].get('bad') else {'result': 1}\n"
        "    print(json.dumps({'id': r['id'], **a}), flush=True)\n"
    )
    registry = Registry()
    registry.register("class", Count)
    registry.register("child", Process((sys.executable, "-c", child)))
    rows = [("class", "{}")] * 3 + [("child", "{}"), ("child", '{"bad": 1}'), ("child", '{"die": 1}'), ("child", "{}"), ("none", "{}")]
    batch = spark.createDataFrame(rows, "cmd string, vars string").coalesce(1)
    for _ in range(2):  # a batch that comes again replaces its rows
        registry.sink(str(tmp_path / "status"))(batch, 5)
    got = sorted((r.cmd, r.status, r.code) for r in spark.read.parquet(str(tmp_path / "status")).where("status != 'completed'").collect())
    assert got == [("child", "failed", 2), ("child", "failed", 42), ("class", "failed", -32603), ("none", "errored", -1)]
    assert spark.read.parquet(str(tmp_path / "status")).count() == 8


def test_states_are_saved_found_and_checked(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/state")
    assert store.load() is None
    for k in range(5):
        store.save({"k": k})
    assert store.load() == {"k": 4} and len(store._numbers()) == 3
    spark.createDataFrame([("no json",)], "value string").coalesce(1).write.text(f"file://{tmp_path}/state/state-9")
    with pytest.raises(ValueError):
        store.load()
    first = SourceRegistry(Store(spark, f"file://{tmp_path}/cp"))
    first.checkpoint("a", {"at": 7})
    again = SourceRegistry(Store(spark, f"file://{tmp_path}/cp"))
    again.register("a", lambda spark, env, after: generate(spark, [{"x": after["at"]}], "x long", 0.5))
    assert again.run(spark, "a").first().x == 7
    runtime, kept = Runtime(spark, [Rule("r", (("a",),))]), Store(spark, f"file://{tmp_path}/rt")
    runtime.metrics.inc("n", 2)
    runtime.save_state(kept)
    other = Runtime(spark)
    assert other.load_state(kept) == ["r"] and other.status()["metrics"] == {"n": 2}


def test_recovery_waits_and_gives_up(spark, tmp_path):
    now = [1000.0]
    recovery = Recovery(Store(spark, f"file://{tmp_path}/recovery"), clock=lambda: now[0])
    assert recovery.begin() == 0
    now[0] += 10
    assert recovery.begin() == 50
    now[0] += 100
    assert recovery.begin() == 0
    with pytest.raises(RuntimeError):
        recovery.begin()
    recovery.clean()
    assert recovery.begin() == 0


def test_backpressure_supervision_and_metrics():
    held = Backpressure()
    assert [held.look(s, n, t) for t, (s, n) in enumerate([(0.4, 0), (0.5, 0), (0.4, 0), (0.35, 600), (0.35, 499), (0, 30_001)])] == [False, True, True, True, False, True]
    assert not held.stuck(100) and held.stuck(305) and Backpressure.options(3) == {"maxFilesPerTrigger": "3"}
    codes = iter([1, None, 0])

    def run():
        code = next(codes)
        if code is None:
            raise RuntimeError
        return code

    assert supervised(run, "s") == "done" and supervised(lambda: 127, "s") == "missing" and supervised(lambda: 0, "s", essential=True) == "stop"
    assert supervised(lambda: 1, "s", most=2) == "given up"
    counts = Metrics()
    counts.inc("b"), counts.inc("b", 2), counts.set("a", 5), counts.log()
    assert counts.snapshot() == {"a": 5, "b": 3}


def test_sources_that_fail_pause_or_are_compressed(spark):
    registry = SourceRegistry()
    registry.register("a", lambda s, env, cp: s.range(3))
    registry.register("b", lambda s, env, cp: 1 / 0)
    assert registry.start_all(spark).count() == 3 and isinstance(registry.failed["b"], ZeroDivisionError)
    registry.pause("a")
    assert registry.start_all(spark) is None
    registry.resume("a")
    assert registry.start_all(spark).count() == 3
    made = zlib.compressobj(wbits=-15)
    raw = made.compress(b'{"method":"log"}') + made.flush()
    rows = spark.createDataFrame([(raw,), (b"\xff\xff",), (None,)], "value binary")
    assert [r.value for r in inflated(rows).collect()] == ['{"method":"log"}', None, None]
    assert [r.after_s for r in generate(spark, [{"x": 1}, {"x": 2}], "x long", 2).orderBy("seq").collect()] == [0.0, 2.0]


def test_rules_that_ask_for_sources(spark):
    rule = Rule("more", (("error",),), mode="single", callbacks={"complete": lambda i: SourceRun("extra", {"n": 2})})
    runtime = Runtime(spark, [rule])
    runtime.sources.register("extra", lambda s, env, cp: s.range(env["n"]))
    asked = runtime.run_emits(load_events(spark, SF), "user_id")["source"]
    assert {k: df.count() for k, df in runtime.run_sources(asked).items()} == {'extra:{"n":2}': 2}


def test_seconds_without_events_count_zero(spark):
    events = spark.createDataFrame([(T0,), (T0,), (T0 + 3 * S,)], "ts timestamp")
    rows = metrics.per_second_filled(events, 5).orderBy("second").collect()
    assert [r.n_events for r in rows] == [0, 2, 0, 0, 1] and metrics.per_second_filled(events.limit(0)).count() == 0
    assert events.where(F.lit(False)).count() == 0
