import json
import os
import signal
import sys
import time
import urllib.error
import urllib.request
from datetime import datetime, timedelta

import pytest

from millrace.management import Saver, on_signals, page, serve
from millrace.operators.fold import Action, Engine, Event
from millrace.operators.rule import Rule
from millrace.runtime import Runtime, State
from millrace.sources import parse_rpc
from millrace.sources.process import CHECKPOINT, ProcessSource, Run
from millrace.state import Store

T0 = datetime(2024, 1, 1)

#: Counts to 6 from its checkpoint, tells it after 2 and 4, and fails once behind 3, where it has no checkpoint but 2.
COUNT = f"""
import json, os
at = json.loads(os.environ.get("{CHECKPOINT}", '{{"at": 0}}'))["at"]
for n in range(at + 1, 7):
    print(json.dumps({{"method": "handle", "params": {{"event": {{"event": "n", "n": n}}}}}}), flush=True)
    if n in (2, 4):
        print(json.dumps({{"method": "checkpoint", "params": {{"at": n}}}}), flush=True)
    if n == 3 and at == 0:
        raise SystemExit(3)
"""


def numbers(lines):
    return [json.loads(x)["params"]["event"]["n"] for x in lines if json.loads(x)["method"] == "handle"]


def options(code, **more):
    return {"command": json.dumps([sys.executable, "-c", code]), **more}


def test_a_process_is_started_again_from_its_checkpoint():
    assert numbers(x for x, *_ in Run(options(COUNT, replays="true"), None).lines()) == [1, 2, 3, 4, 5, 6]
    assert numbers(x for x, *_ in Run(options(COUNT), None).lines()) == [1, 2, 3, 3, 4, 5, 6]
    assert numbers(x for x, *_ in Run(options(COUNT), '{"at": 4}').lines()) == [5, 6]
    own = Run(options(COUNT, env=json.dumps({CHECKPOINT: '{"at": 5}'})), '{"at": 4}')
    assert numbers(x for x, *_ in own.lines()) == [6]
    assert list(Run({"command": '["/no/such/program"]'}, None).lines()) == []
    with pytest.raises(RuntimeError):
        list(Run(options("raise SystemExit(1)"), None).lines())


def test_a_compressed_process():
    code = "import sys, zlib\nz = zlib.compressobj(wbits=-15)\nfor x in (b'{\"a\":1}', b'', b'[2]'):\n    sys.stdout.buffer.write(z.compress(x + b'\\n') + z.flush(zlib.Z_SYNC_FLUSH))\n"
    assert [x for x, *_ in Run(options(code, compressed="true"), None).lines()] == ['{"a":1}', "[2]"]


def test_a_process_as_table_and_stream(spark, tmp_path):
    spark.dataSource.register(ProcessSource)
    rows = spark.read.format("process").options(**options(COUNT, replays="true")).load()
    got = parse_rpc(rows)
    assert sorted(json.loads(r.event)["n"] for r in got["handle"].collect()) == [1, 2, 3, 4, 5, 6]
    assert got["checkpoint"].count() == 2 and got["rejected"].count() == 0
    stream = spark.readStream.format("process").options(**options(COUNT, replays="true", most="3")).load()
    for end in (4, 8):  # the second query goes on where the first one was stopped
        writer = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
        query = writer.trigger(processingTime="200 milliseconds").start()
        until = time.time() + 60
        while time.time() < until and (not os.path.exists(f"{tmp_path}/out/_spark_metadata") or spark.read.schema("value string").parquet(f"{tmp_path}/out").count() < end):
            time.sleep(0.3)
        query.stop()
    assert sorted(numbers(r.value for r in spark.read.schema("value string").parquet(f"{tmp_path}/out").collect())) == [1, 2, 3, 4, 5, 6]


def test_emitted_events_may_go_to_an_action(spark):
    rule = Rule("a", (("x",),), mode="single", callbacks={"complete": lambda i: Event("y", i.chain[0].datetime, None, {"k": 1})})
    seen = Rule("b", (("y",),), mode="single")
    for action, came_back in ((None, True), ("store", False)):
        engine = Engine([rule, seen], event_action=action)
        engine.handle(Event("x", T0, 1, {}))
        made = engine.take_emitted()
        assert any(name == "b" for name, *_ in engine.take()) is came_back
        assert [x.cmd for _, x, *_ in made if isinstance(x, Action)] == [action] * bool(action)
    runtime = Runtime(spark, [rule])
    runtime.event_action = "store"
    runtime.actions.register("store")
    events = spark.createDataFrame([(1, T0, "x", 1.0, 7)], "event_id long, ts timestamp, event_type string, value double, user_id long")
    (row,) = runtime.run_emits(events, "user_id")["actions"].collect()
    assert (row.cmd, row.status, json.loads(row.vars)["event"]) == ("store", "ready", "y")


def test_streams_take_late_events_without_a_delay(spark, tmp_path):
    rule = Rule("seq", (("a",), ("b",)), timedelta(hours=1), ("user_id",))
    schema = "event_id long, ts timestamp, event_type string, value double, user_id long"
    first = [(1, T0, "a", 0.0, 1), (2, T0 + timedelta(days=2), "c", 0.0, 2)]
    more = [(4, T0 + timedelta(days=3), "c", 0.0, 2)]  # rows are late by the watermark of the batch before the last
    late = [(3, T0 + timedelta(minutes=5), "b", 0.0, 1)]
    for rows in (first, more, late):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken by age
    found = {}
    for name, delay in (("kept", None), ("dropped", "0 seconds")):
        got = []
        runtime = Runtime(spark, [rule], checkpoint=f"{tmp_path}/{name}")
        runtime.state = State.RUNNING
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = runtime.run_stream(stream, "user_id", lambda b, _, to=got: to.extend(b.collect()), name=name, delay=delay, once=True)
        query.awaitTermination(60)
        assert query.exception() is None
        found[name] = {(r.phase, r.first_id, r.last_id) for r in got}
    assert ("complete", 1, 3) in found["kept"]
    assert ("complete", 1, 3) not in found["dropped"]


def test_saver():
    now, saved, broken = [0.0], [], [False]

    def save():
        if broken[0]:
            raise OSError("full")
        saved.append(now[0])

    def tick(at):
        now[0] = at
        made = saver.tick()
        if saver.thread:
            saver.thread.join()
        return made

    saver = Saver(save, most=2, clock=lambda: now[0])
    assert not tick(0.0)
    saver.dirty = True
    assert tick(0.5) and not tick(2.0) and saved == [0.5]
    saver.dirty = True
    assert not tick(1.0) and tick(2.5)
    assert tick(3600.0) and not tick(3601.5) and saved == [0.5, 2.5, 3600.0]
    broken[0] = saver.dirty = True
    assert tick(3700.0) and tick(3702.0) and saver.failures == 2 and saver.dirty
    with pytest.raises(OSError):
        tick(3704.0)
    broken[0] = False
    assert saver.dirty and tick(3706.0) and saver.failures == 0 and saved[-1] == 3706.0


def test_signals_and_the_page(spark, tmp_path):
    runtime, store = Runtime(spark), Store(spark, f"{tmp_path}/state")
    runtime.move(State.RUNNING)
    server = serve(runtime, port=0)
    old = on_signals(runtime, store)
    try:
        top = f"http://127.0.0.1:{server.server_port}"
        text = urllib.request.urlopen(f"{top}/", timeout=10).read().decode()
        assert "running" in text and "<" not in page({"<": 1}).split("<th>")[1].split("</th>")[0]
        for code, path, data in ((404, "/x", None), (405, "/", b""), (404, "/x", b"")):
            with pytest.raises(urllib.error.HTTPError) as error:
                urllib.request.urlopen(f"{top}{path}", data=data, timeout=10)
            assert error.value.code == code
        runtime.status = lambda: 1 / 0
        with pytest.raises(urllib.error.HTTPError) as error:
            urllib.request.urlopen(f"{top}/", timeout=10)
        assert error.value.code == 500
        os.kill(os.getpid(), signal.SIGHUP)
        assert store.load()["state"] == "running"
        os.kill(os.getpid(), signal.SIGTERM)
        assert runtime.state is State.STOPPED and store.load()["state"] == "stopping"
    finally:
        server.shutdown()
        for kind, handler in old.items():
            signal.signal(kind, handler)
