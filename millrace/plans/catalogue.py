"""Registered queries of the engine's operators over the synthetic tables.

The correlation key is user_id, an event's type event_type, its time ts; order is (ts, event_id).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import functions as fn
from millrace import streaming
from millrace.operators import actions, exact, memory, metrics, patterns, temporal
from millrace.operators.fold import Action, Event, MemoryWrite
from millrace.operators.rule import Rule, on_schedule
from millrace.operators.rule import validate_enrich_filter as validate_enrich_filter_rule
from millrace.runtime import Runtime
from millrace.sources import SourceRegistry, load_events, resume
from millrace.state import Store
from millrace.streaming.once import available, events_stream, folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HOUR = timedelta(hours=1)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def ntz(*columns: str):
    return {c: F.col(c).cast("timestamp_ntz") for c in columns}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- filters and single steps -------------------------------------------------------------------------------------------

BASIC = "event_id, user_id, event_type, value"


@query(f"SELECT {BASIC} FROM events WHERE event_type = 'purchase'")
def match_single(spark, sf_dir):
    return patterns.single(load_events(spark, sf_dir), Rule("buy", (("purchase",),), mode="single")).selectExpr(*BASIC.split(", "))


@query(f"SELECT {BASIC} FROM events")
def match_any(spark, sf_dir):
    return patterns.single(load_events(spark, sf_dir), Rule("any", (("*",),), mode="single")).selectExpr(*BASIC.split(", "))


@query(f"SELECT {BASIC} FROM events WHERE event_type IN ('error', 'signup')")
def match_type_or(spark, sf_dir):
    rule = Rule("either", (("error", "signup"),), mode="single")
    return patterns.single(load_events(spark, sf_dir), rule).selectExpr(*BASIC.split(", "))


@query("SELECT event_id, value FROM events WHERE value BETWEEN 10 AND 50")
def range_inclusive(spark, sf_dir):
    return load_events(spark, sf_dir).where(fn.range_inclusive(F.col("value"), 50.0, 10.0)).select("event_id", "value")


@query("SELECT event_id, value FROM events WHERE value > 10 AND value < 50")
def range_exclusive(spark, sf_dir):
    return load_events(spark, sf_dir).where(fn.range_exclusive(F.col("value"), 50.0, 10.0)).select("event_id", "value")


@query("""WITH e AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events),
f AS (SELECT *, first_value(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k0 FROM e)
SELECT event_id, user_id, k FROM f WHERE k IS NOT DISTINCT FROM k0""")
def context_null_safe(spark, sf_dir):
    e = load_events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k"))
    e = e.withColumn("k0", F.first("k").over(patterns.ordered("user_id")))
    return e.where(F.col("k").eqNullSafe(F.col("k0"))).select("event_id", "user_id", "k")


# --- sequences ----------------------------------------------------------------------------------------------------------

def lookup(types: str, field: str) -> str:
    return f"first_value(CASE WHEN event_type IN ({types}) THEN {field} END IGNORE NULLS) OVER w"


SIGNUP_BUY = Rule("welcome", (("signup",), ("purchase",)), 6 * HOUR, ("user_id",))
TWO = f"WITH x AS (SELECT *, {lookup(chr(39) + 'purchase' + chr(39), 'ts')} AS nts, {lookup(chr(39) + 'purchase' + chr(39), 'event_id')} AS nid FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), a AS (SELECT *, ts + INTERVAL 6 HOUR AS deadline, (SELECT max(ts) FROM events) - INTERVAL 1 MILLISECOND AS clock FROM x WHERE event_type = 'signup')"


@query(f"{TWO} SELECT user_id, event_id AS id1, nid AS id2, ts AS ts1, nts AS ts2 FROM a WHERE nts <= deadline")
def seq_followed_by_within(spark, sf_dir):
    made = patterns.completed(load_events(spark, sf_dir), SIGNUP_BUY)
    return made.select("user_id", "id1", "id2", "ts1", "ts2").withColumns(ntz("ts1", "ts2"))


@query(f"{TWO} SELECT user_id, event_id AS id1, deadline FROM a WHERE (nts IS NULL OR nts > deadline) AND clock >= deadline")
def absence_timeout(spark, sf_dir):
    made = patterns.timed_out(load_events(spark, sf_dir), SIGNUP_BUY)
    return made.select("user_id", "id1", "deadline").withColumns(ntz("deadline"))


@query(f"{TWO} SELECT user_id, event_id AS id1 FROM a WHERE (nts IS NULL OR nts > deadline) AND clock < deadline")
def pending_instances(spark, sf_dir):
    return patterns.pending(load_events(spark, sf_dir), SIGNUP_BUY).select("user_id", "id1")


@query(f"{TWO} SELECT user_id, event_id AS id1, deadline FROM a WHERE (nts IS NULL OR nts > deadline) AND clock < deadline ORDER BY deadline, event_id LIMIT 10")
def next_timeout(spark, sf_dir):
    made = patterns.pending(load_events(spark, sf_dir), SIGNUP_BUY).select("user_id", "id1", "deadline")
    return made.orderBy("deadline", "id1").limit(10).withColumns(ntz("deadline"))


@query(f"{TWO} SELECT user_id, event_id AS id1, nid AS id2 FROM a WHERE nid IS NOT NULL")
def seq_no_timeout(spark, sf_dir):
    rule = Rule("ever", SIGNUP_BUY.steps, None, ("user_id",))
    return patterns.completed(load_events(spark, sf_dir), rule).select("user_id", "id1", "id2")


@query(f"{TWO} SELECT user_id, event_id AS id1, nid AS id2 FROM a WHERE nid IS NOT NULL")
def historical_ignore_timeout(spark, sf_dir):
    rule = Rule("ever", SIGNUP_BUY.steps, 6 * HOUR, ("user_id",), ignore_timeout_in_batch=True)
    return patterns.completed(load_events(spark, sf_dir), rule).select("user_id", "id1", "id2")


@query("""WITH x AS (SELECT *, first_value(CASE WHEN event_type = 'purchase' THEN {'t': ts, 'i': event_id} END IGNORE NULLS) OVER w AS p
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
y AS (SELECT *, first_value(CASE WHEN event_type = 'click' THEN {'t': ts, 'i': event_id, 'p': p} END IGNORE NULLS) OVER w AS c
  FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id AS id1, c.i AS id2, c.p.i AS id3 FROM y WHERE event_type = 'signup' AND c.t <= ts + INTERVAL 12 HOUR AND c.p.t <= c.t + INTERVAL 12 HOUR""")
def seq_three_step(spark, sf_dir):
    rule = Rule("three", (("signup",), ("click",), ("purchase",)), 12 * HOUR, ("user_id",))
    return patterns.completed(load_events(spark, sf_dir), rule).select("user_id", "id1", "id2", "id3")


@query(f"WITH x AS (SELECT *, {lookup(chr(39) + 'click' + chr(39) + ',' + chr(39) + 'view' + chr(39), 'ts')} AS nts, {lookup(chr(39) + 'click' + chr(39) + ',' + chr(39) + 'view' + chr(39), 'event_id')} AS nid FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) SELECT user_id, event_id AS id1, nid AS id2 FROM x WHERE event_type = 'signup' AND nts <= ts + INTERVAL 6 HOUR")
def seq_step_or(spark, sf_dir):
    rule = Rule("look", (("signup",), ("click", "view")), 6 * HOUR, ("user_id",))
    return patterns.completed(load_events(spark, sf_dir), rule).select("user_id", "id1", "id2")


@query("WITH x AS (SELECT *, first_value(CASE WHEN event_type = 'purchase' THEN ts END IGNORE NULLS) OVER w AS nts, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS nid FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) SELECT event_id AS id1, nid AS id2 FROM x WHERE event_type = 'error' AND nts <= ts + INTERVAL 1 HOUR")
def seq_uncorrelated(spark, sf_dir):
    return patterns.next_of_any(load_events(spark, sf_dir), {"error"}, {"purchase"}, HOUR).select("id1", "id2")


@query("""WITH x AS (SELECT user_id, event_id, row_number() OVER w AS n, lead(event_id) OVER w AS nid FROM events
WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id AS id1, nid AS id2, ((n + 1) // 2)::BIGINT AS nth FROM x WHERE n % 2 = 1 AND nid IS NOT NULL""")
def pair_same_type(spark, sf_dir):
    return patterns.pairs(load_events(spark, sf_dir), {"error"}, "user_id")


@query("""SELECT user_id, event_id, count(*) OVER w AS n_seen, sum(round(value, 2)::DECIMAL(18,2)) OVER w::DOUBLE AS value_sum
FROM events WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def continuous_running(spark, sf_dir):
    return patterns.running(load_events(spark, sf_dir), {"click"}, "user_id")


@query("""SELECT event_id, user_id, count(*) OVER w AS n_held, min(event_id) OVER w AS oldest_id, max(value) OVER w AS most
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING)""")
def last_n_buffer(spark, sf_dir):
    held = patterns.last_n(load_events(spark, sf_dir), 10, "user_id")
    return held.select(
        "event_id", "user_id", F.size("buffer").cast("long").alias("n_held"), F.col("buffer")[0]["event_id"].alias("oldest_id"),
        F.array_max(F.transform("buffer", lambda b: b["value"])).alias("most"),
    )


SESSIONS = """WITH x AS (SELECT user_id, ts, event_id, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS brk
FROM events WHERE event_type IN ('click', 'view') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM x)
SELECT user_id, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM y GROUP BY user_id, s"""


@query(SESSIONS)
def session_timeout(spark, sf_dir):
    made = patterns.sessions(load_events(spark, sf_dir), {"click", "view"}, "user_id", 12 * HOUR)
    return made.withColumns(ntz("first_ts", "last_ts"))


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE event_type IN ('click', 'view')),
r AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id
 UNION ALL SELECT r.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = r.user_id AND e.ts > r.ts + INTERVAL 24 HOUR) AS ts FROM r WHERE r.ts IS NOT NULL)
SELECT r.user_id, r.ts AS first_ts, (SELECT count(*) FROM e WHERE e.user_id = r.user_id AND e.ts BETWEEN r.ts AND r.ts + INTERVAL 24 HOUR) AS n_events FROM r WHERE r.ts IS NOT NULL""")
def anchored_window(spark, sf_dir):
    return patterns.anchored(load_events(spark, sf_dir), {"click", "view"}, "user_id", 24 * HOUR).withColumns(ntz("first_ts"))


@query("SELECT user_id, event_type, arg_min(event_id, ts) AS first_id, arg_max(event_id, ts) AS last_id, count(*) AS n_events FROM events GROUP BY ALL")
def first_last_of_type(spark, sf_dir):
    return patterns.first_event_of(load_events(spark, sf_dir), "user_id")


@query("SELECT event_type, arg_min(event_id, ts) AS first_id, arg_max(event_id, ts) AS last_id, count(*) AS n_events FROM events GROUP BY ALL")
def dedupe_matchers(spark, sf_dir):
    return patterns.first_event_of(load_events(spark, sf_dir), None)


# --- the exact engine ---------------------------------------------------------------------------------------------------

@query(f"""{TWO} SELECT 'welcome' AS rule, CASE WHEN nts <= deadline THEN 'complete' ELSE 'timeout' END AS phase, event_id AS first_id FROM a
WHERE nts <= deadline OR clock >= deadline""")
def exact_sequence(spark, sf_dir):
    made = exact.run(load_events(spark, sf_dir), [SIGNUP_BUY], "user_id")
    return made.select("rule", "phase", "first_id")


@query("""WITH x AS (SELECT user_id, event_id, row_number() OVER w AS n, lead(event_id) OVER w AS nid FROM events
WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id AS first_id, nid AS last_id FROM x WHERE n % 2 = 1 AND nid IS NOT NULL""")
def exact_pairs(spark, sf_dir):
    rule = Rule("twice", (("error",), ("error",)), None, ("user_id",))
    return exact.run(load_events(spark, sf_dir), [rule], "user_id").where("phase = 'complete'").select("first_id", "last_id")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events WHERE event_type IN ('signup', 'purchase')), z AS (SELECT max(ts) - INTERVAL 1 MILLISECOND AS clock FROM events),
w AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS open_id, NULL::TIMESTAMP AS due, NULL::VARCHAR AS phase, NULL::BIGINT AS first_id, NULL::BIGINT AS last_id, NULL::TIMESTAMP AS ended FROM e
  UNION ALL SELECT e.user_id, e.n,
    CASE WHEN e.event_type = 'signup' AND NOT coalesce(e.ts <= w.due, false) THEN e.event_id END,
    CASE WHEN e.event_type = 'signup' AND NOT coalesce(e.ts <= w.due, false) THEN e.ts + INTERVAL 6 HOUR END,
    CASE WHEN w.due IS NULL THEN NULL WHEN e.ts <= w.due THEN 'complete' ELSE 'timeout' END, w.open_id,
    CASE WHEN e.ts <= w.due THEN e.event_id ELSE w.open_id END,
    CASE WHEN e.ts > w.due AND w.due <= e.ts - INTERVAL 1 MILLISECOND THEN w.due ELSE e.ts END
  FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1),
o AS (SELECT phase, first_id, last_id, ended FROM w WHERE phase IS NOT NULL
  UNION ALL SELECT 'timeout', open_id, open_id, due FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS back FROM w), z WHERE back = 1 AND due <= clock)
SELECT 'overlap' AS rule, phase, CASE phase WHEN 'complete' THEN 2 ELSE 1 END::BIGINT AS n_events, first_id, last_id, ended AS "at" FROM o""")
def exact_overlapping(spark, sf_dir):
    """A first step whose type comes again in the second: only the engine gives this one."""
    rule = Rule("overlap", (("signup",), ("purchase", "signup")), 6 * HOUR, ("user_id",))
    return exact.run(load_events(spark, sf_dir), [rule], "user_id").withColumns(ntz("at"))


def _no_purchase(instance):
    first = instance.chain[0]
    return Event("no_purchase", instance.timeout, first.id, {"user_id": first.get("user_id")})


def _mail(instance):
    return [Action("mail", {"user": instance.chain[0].get("user_id")}), MemoryWrite("nudged", str(instance.chain[0].get("user_id")), True, 3600)]


LATE_IDS = f"{TWO}, d AS (SELECT event_id, user_id FROM a WHERE (nts IS NULL OR nts > deadline) AND clock >= deadline)"


@query(f"""{LATE_IDS} SELECT kind, rule, name, count(*) AS n FROM d, (VALUES ('event', 'welcome', 'no_purchase'), ('action', 'nudge', 'mail'), ('memory', 'nudge', 'nudged')) v(kind, rule, name) GROUP BY ALL""")
def runtime_chaining(spark, sf_dir):
    """A rule's timeout emits an event that comes back in, where another rule emits an action and a write to the memory."""
    rules = [
        Rule("welcome", SIGNUP_BUY.steps, 6 * HOUR, ("user_id",), callbacks={"timeout": _no_purchase}),
        Rule("nudge", (("no_purchase",),), mode="single", callbacks={"complete": _mail}),
    ]
    made = exact.emits(load_events(spark, sf_dir), rules, "user_id")
    named = made.withColumn("name", F.coalesce(F.when(F.col("kind") == "memory", F.get_json_object("payload", "$.ns")), "name"))
    return named.groupBy("kind", "rule", "name").agg(F.count("*").alias("n"))


@query(f"{LATE_IDS} SELECT 'mail' AS cmd, user_id, count(*) AS n FROM d GROUP BY ALL")
def emitted_actions(spark, sf_dir):
    """Actions that rules emit, dispatched by the registry."""
    rules = [
        Rule("welcome", SIGNUP_BUY.steps, 6 * HOUR, ("user_id",), callbacks={"timeout": _no_purchase}),
        Rule("nudge", (("no_purchase",),), mode="single", callbacks={"complete": _mail}),
    ]
    runtime = Runtime(spark, rules)
    runtime.actions.register("mail", schema={"type": "object", "properties": {"user": {"type": "integer"}}, "required": ["user"]})
    ready = runtime.run_emits(load_events(spark, sf_dir), "user_id")["actions"].where("status = 'ready'")
    return ready.groupBy("cmd", F.get_json_object("vars", "$.user").cast("long").alias("user_id")).agg(F.count("*").alias("n"))


@query(f"""{TWO}, c AS (SELECT * FROM a WHERE nts <= deadline)
SELECT 'seen' AS group_name, event_type AS name, count(*) AS n FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY event_type
UNION ALL SELECT 'init_matcher', 'welcome', count(*) FROM a UNION ALL SELECT 'handled', 'signup|welcome', count(*) FROM a
UNION ALL SELECT 'handled', 'purchase|welcome', count(*) FROM c UNION ALL SELECT 'completed_matcher', 'welcome', count(*) FROM c
UNION ALL SELECT 'unhandled', 'purchase', (SELECT count(*) FROM events WHERE event_type = 'purchase') - (SELECT count(DISTINCT nid) FROM c)
UNION ALL SELECT 'timeouts', 'welcome', count(*) FROM a WHERE (nts IS NULL OR nts > deadline) AND clock >= deadline""")
def engine_stats(spark, sf_dir):
    """The engine's counters; timeouts by the clock and by a late event are taken together."""
    made = exact.stats(load_events(spark, sf_dir), [SIGNUP_BUY], "user_id")
    group = F.when(F.col("group_name").endswith("matcher_timeout"), "timeouts").otherwise(F.col("group_name")).alias("group_name")
    return made.groupBy(group, "name").agg(F.sum("n").alias("n"))


def _big(event):
    return event if event.get("value") is not None and event.get("value") >= 5 else None


def _banded(event):
    event.data["band"] = int(event.get("value") // 50)
    return event


def _not_top(event):
    return event if event.get("band") < 3 else None


@query("""WITH e AS (SELECT coalesce(value >= 5 AND floor(value / 50) < 3, false) AS ok FROM events)
SELECT 'check' AS rule, CASE WHEN ok THEN 'passed' ELSE 'failed' END AS phase, count(*) AS n FROM e GROUP BY ALL
UNION ALL SELECT 'any', 'complete', count(*) FROM e WHERE ok""")
def vef_rule(spark, sf_dir):
    """Validate, enrich and filter as a rule: a rejected event is suppressed, so the later rule doesn't see it."""
    check = validate_enrich_filter_rule("check", ("*",), _big, _banded, _not_top)
    rules = [check, Rule("any", (("*",),), mode="single")]
    made = exact.run(load_events(spark, sf_dir), rules, "user_id", ("passed", "failed", "complete"))
    return made.groupBy("rule", "phase").agg(F.count("*").alias("n"))


@query("""SELECT 'typed' AS rule, count(*) AS n FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'wild', count(*) FROM events""")
def typed_before_wildcard(spark, sf_dir):
    """A wildcard rule that suppresses, registered first, doesn't keep an event from a rule of its type."""
    rules = [Rule("wild", (("*",),), mode="single", suppress=True), Rule("typed", (("purchase",),), mode="single")]
    return exact.run(load_events(spark, sf_dir), rules, "user_id").groupBy("rule").agg(F.count("*").alias("n"))


# --- validate, enrich, filter; suppression; chaining --------------------------------------------------------------------

PASSED = """WITH e AS (SELECT e.*, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, c.c_mktsegment
FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey)"""


def _enriched(spark, sf_dir):
    segment = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")

    def enrich(e):
        return e.join(segment, e["user_id"] == segment["c_custkey"], "left")  # Spark broadcasts it where its size allows

    e = load_events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    return patterns.validate_enrich_filter(e, F.col("k") >= 10, enrich, F.col("c_mktsegment").isNotNull() & (F.col("value") > 20))


@query(f"{PASSED} SELECT event_type, count(*) AS n FROM e WHERE k >= 10 AND c_mktsegment IS NOT NULL AND value > 20 GROUP BY event_type")
def vef_suppresses(spark, sf_dir):
    """What rules after the three stages see."""
    return patterns.unsuppressed(_enriched(spark, sf_dir)).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"{PASSED} SELECT event_id, k, c_mktsegment FROM e WHERE k >= 10 AND c_mktsegment IS NOT NULL AND value > 20")
def validate_enrich_filter(spark, sf_dir):
    return _enriched(spark, sf_dir).where("passed").select("event_id", "k", "c_mktsegment")


@query(f"{PASSED} SELECT event_id FROM e WHERE NOT coalesce(k >= 10 AND c_mktsegment IS NOT NULL AND value > 20, false)")
def vef_rejects(spark, sf_dir):
    return _enriched(spark, sf_dir).where("not passed").select("event_id")


@query("SELECT e.event_id, c.c_name, n.n_name FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey")
def enrich_broadcast(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    e = load_events(spark, sf_dir).select("event_id", "user_id")
    named = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", "c_name", "n_name")
    return e.join(named, e["user_id"] == named["c_custkey"]).select("event_id", "c_name", "n_name")


@query("""SELECT rule, count(*) AS n FROM (SELECT 'guard' AS rule FROM events WHERE value < 5
UNION ALL SELECT 'any' FROM events WHERE value >= 5 UNION ALL SELECT 'buy' FROM events WHERE value >= 5 AND event_type = 'purchase') GROUP BY rule""")
def suppression_priority(spark, sf_dir):
    rules = [("guard", F.col("value") < 5, True), ("any", F.lit(True), False), ("buy", F.col("event_type") == "purchase", False)]
    return patterns.suppress(load_events(spark, sf_dir), rules).groupBy("rule").agg(F.count("*").alias("n"))


def _derived(spark, sf_dir):
    late = patterns.timed_out(load_events(spark, sf_dir), SIGNUP_BUY)
    return late.select(F.col("id1").alias("event_id"), F.col("deadline").alias("ts"), "user_id", F.lit("no_purchase").alias("event_type"))


LATE = f"{TWO}, d AS (SELECT event_id, deadline AS ts, user_id, 'no_purchase' AS event_type FROM a WHERE (nts IS NULL OR nts > deadline) AND clock >= deadline)"


@query(f"{LATE} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM d GROUP BY ALL")
def rule_chaining(spark, sf_dir):
    """What one rule's timeouts emit is counted by day by another."""
    return _derived(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query(f"{LATE} SELECT event_type, count(*) AS n, min(ts) AS first_ts FROM (SELECT event_type, ts FROM events UNION ALL SELECT event_type, ts FROM d) GROUP BY event_type")
def derived_event_union(spark, sf_dir):
    both = load_events(spark, sf_dir).unionByName(_derived(spark, sf_dir), allowMissingColumns=True)
    return both.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts")).withColumns(ntz("first_ts"))


# --- shared memory ------------------------------------------------------------------------------------------------------

def _log(events, type_="signup", hours=6):
    rows = events.where(F.col("event_type") == type_).select(
        F.lit("user").alias("ns"), F.col("user_id").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
        F.col("ts").alias("written_at"), F.lit(hours * 3600).cast("long").alias("ttl_s"), (F.col("event_id") % 2 == 0).alias("persistent"), F.col("event_id").alias("seq"),
    )
    return memory.writes(rows)


ASOF = """WITH r AS (SELECT * FROM events WHERE event_type = 'purchase'), w AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'signup'),
j AS (SELECT r.event_id, r.user_id, r.ts, w.ts AS wts, w.event_id AS write_id FROM r ASOF LEFT JOIN w ON r.user_id = w.user_id AND r.ts > w.ts)"""


def _reads(spark, sf_dir):
    e = load_events(spark, sf_dir)
    log = _log(e).withColumn("value", F.col("seq").cast("string"))
    reads = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return memory.get(reads, log, "user_id")


@query(f"{ASOF} SELECT event_id, user_id, CASE WHEN wts + INTERVAL 6 HOUR > ts THEN write_id END AS write_id FROM j")
def memory_get_ttl(spark, sf_dir):
    return _reads(spark, sf_dir).select("event_id", "user_id", F.col("memory_value").cast("long").alias("write_id"))


@query(f"{ASOF} SELECT event_id FROM j WHERE wts + INTERVAL 6 HOUR > ts")
def memory_has(spark, sf_dir):
    e = load_events(spark, sf_dir)
    return memory.has(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), _log(e), "user_id").select("event_id")


LAST = "WITH l AS (SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS seq FROM events WHERE event_type = 'signup' GROUP BY user_id), m AS (SELECT *, ts + INTERVAL 48 HOUR > (SELECT max(ts) FROM events) AS alive FROM l)"


@query(f"{LAST} SELECT user_id::VARCHAR AS key, seq FROM m WHERE alive")
def memory_all_snapshot(spark, sf_dir):
    e = load_events(spark, sf_dir)
    return memory.snapshot(_log(e, hours=48), patterns.stream_end(e)).select("key", "seq")


@query(f"{LAST} SELECT 'user' AS ns, count(*) AS purged FROM m WHERE NOT alive")
def memory_purge_expired(spark, sf_dir):
    e = load_events(spark, sf_dir)
    return memory.purge_count(_log(e, hours=48), patterns.stream_end(e))


@query(f"{LAST} SELECT user_id::VARCHAR AS key FROM m WHERE alive AND seq % 2 = 0")
def memory_persist_filter(spark, sf_dir):
    e = load_events(spark, sf_dir)
    return memory.snapshot(_log(e, hours=48), patterns.stream_end(e)).where("persistent").select("key")


# --- metrics ------------------------------------------------------------------------------------------------------------

@query("SELECT 'seen' AS group_name, event_type AS name, count(*) AS n FROM events GROUP BY event_type")
def stats_seen(spark, sf_dir):
    return metrics.counters(load_events(spark, sf_dir), "seen", F.col("event_type"))


@query("""SELECT 'handled' AS group_name, name, count(*) AS n FROM (SELECT 'any' AS name FROM events UNION ALL
SELECT 'buy' FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'last10' FROM events WHERE event_type = 'click') GROUP BY name""")
def stats_handled(spark, sf_dir):
    rules = [("any", F.lit(True), False), ("buy", F.col("event_type") == "purchase", False), ("last10", F.col("event_type") == "click", False)]
    return metrics.counters(patterns.suppress(load_events(spark, sf_dir), rules), "handled", F.col("rule"))


@query("SELECT 'unhandled' AS group_name, event_type AS name, count(*) AS n FROM events WHERE event_type NOT IN ('purchase', 'click') GROUP BY event_type")
def stats_unhandled(spark, sf_dir):
    missed = load_events(spark, sf_dir).where(~patterns.of_types({"purchase", "click"}))
    return metrics.counters(missed, "unhandled", F.col("event_type"))


@query("SELECT epoch(ts)::BIGINT AS second, count(*) AS n_events FROM (SELECT date_trunc('second', ts) AS ts FROM events) GROUP BY ALL")
def eps_per_second(spark, sf_dir):
    return metrics.per_second(load_events(spark, sf_dir))


@query("""WITH c AS (SELECT epoch(date_trunc('second', ts))::BIGINT AS second, count(*) AS n FROM events GROUP BY ALL),
z AS (SELECT epoch(date_trunc('second', max(ts)))::BIGINT AS last FROM events), s AS (SELECT unnest(range(last - 3599, last + 1)) AS second FROM z)
SELECT s.second, coalesce(c.n, 0)::BIGINT AS n_events FROM s LEFT JOIN c ON s.second = c.second""")
def eps_last_hour(spark, sf_dir):
    return metrics.per_second_filled(load_events(spark, sf_dir))


@query("""WITH s AS (SELECT epoch(date_trunc('second', ts))::BIGINT AS second, count(*) AS n FROM events GROUP BY ALL)
SELECT second, round(sum(n) OVER (ORDER BY second RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) / 3600, 2) AS load_3600,
round(sum(n) OVER (ORDER BY second RANGE BETWEEN 899 PRECEDING AND CURRENT ROW) / 900, 2) AS load_900,
round(sum(n) OVER (ORDER BY second RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) / 60, 2) AS load_60 FROM s""")
def load_average(spark, sf_dir):
    return metrics.load_averages(load_events(spark, sf_dir))


@query("SELECT CASE WHEN value <= 10 THEN '10' WHEN value <= 50 THEN '50' WHEN value <= 100 THEN '100' WHEN value <= 200 THEN '200' ELSE '+Inf' END AS bucket, count(*) AS n FROM events GROUP BY ALL")
def histogram_value(spark, sf_dir):
    return metrics.histogram(load_events(spark, sf_dir), F.col("value"), [10, 50, 100, 200])


@query("""WITH d AS (SELECT length(text) AS n FROM documents WHERE text IS NOT NULL)
SELECT coalesce((SELECT min(b)::VARCHAR FROM (SELECT unnest([64 << i FOR i IN range(15)]) AS b) WHERE d.n <= b), '+Inf') AS bucket, count(*) AS n FROM d GROUP BY ALL""")
def histogram_packet_size(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.char_length("text").alias("size"))
    return metrics.histogram(docs, F.col("size"), metrics.PACKET_BOUNDS)


@query("SELECT event_id, event_type, props FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_events(spark, sf_dir):
    return metrics.recent(load_events(spark, sf_dir)).select("event_id", "event_type", "props")


# --- schedules ----------------------------------------------------------------------------------------------------------

def _bounds(spark, sf_dir):
    e = load_events(spark, sf_dir)
    return e.agg(F.min("ts").alias("start"), F.max("ts").alias("stop"))


RANGE = "WITH b AS (SELECT min(ts) AS a, max(ts) AS z FROM events), m AS (SELECT unnest(generate_series(date_trunc('minute', a), z, INTERVAL 1 MINUTE)) AS t, a, z FROM b)"


@query(f"""{RANGE}, k AS (SELECT t, lag(t) OVER (ORDER BY t) AS p FROM m WHERE minute(t) = 0 AND t > a AND t <= z)
SELECT t AS tick, (SELECT count(*) FROM events e WHERE e.ts <= k.t AND (k.p IS NULL OR e.ts > k.p)) AS n_events FROM k""")
def cron_hourly(spark, sf_dir):
    ticks = temporal.cron_ticks(_bounds(spark, sf_dir), "@hourly")
    e = load_events(spark, sf_dir)
    up = F.when(F.col("ts") == F.date_trunc("hour", "ts"), F.col("ts")).otherwise(F.date_trunc("hour", "ts") + F.expr("interval 1 hour"))
    counts = e.groupBy(up.alias("tick")).agg(F.count("*").alias("n_events"))
    return ticks.join(counts, "tick", "left").select(F.col("tick").cast("timestamp_ntz").alias("tick"), F.coalesce("n_events", F.lit(0)).alias("n_events"))


@query(f"""{RANGE} SELECT 'hourly' AS rule, t AS at FROM m WHERE minute(t) = 0 AND t > a AND t <= z
UNION ALL SELECT 'noon', t FROM m WHERE minute(t) = 0 AND hour(t) = 12 AND t > a AND t <= z""")
def schedule_rules(spark, sf_dir):
    rules = [on_schedule("hourly", str, "@hourly"), on_schedule("noon", str, "0 12 * * *")]
    return Runtime(spark, rules).ticks(load_events(spark, sf_dir)).withColumns(ntz("at"))


@query(f"""{RANGE} SELECT t AS tick FROM m WHERE t > a AND t <= z
AND strftime(timezone('Australia/Sydney', timezone('UTC', t)), '%H:%M') = '09:30' AND dayofweek(timezone('Australia/Sydney', timezone('UTC', t))) BETWEEN 1 AND 5""")
def cron_weekday_0930_tz(spark, sf_dir):
    return temporal.cron_ticks(_bounds(spark, sf_dir), "30 9 * * mon-fri", "Australia/Sydney").withColumns(ntz("tick"))


@query("""WITH b AS (SELECT min(ts) AS a, max(ts) AS z FROM events), s AS (SELECT a, unnest(generate_series(a + INTERVAL 10 MINUTE, z, INTERVAL 10 MINUTE)) AS t FROM b)
SELECT t AS datetime, row_number() OVER (ORDER BY t) - 1 AS seq, (epoch_us(t) - epoch_us(a))::BIGINT AS runtime_us FROM s""")
def heartbeat(spark, sf_dir):
    return temporal.heartbeats(_bounds(spark, sf_dir), 600).withColumns(ntz("datetime"))


@query("""SELECT event, count(*) AS n, min(t) AS first_at FROM (SELECT event_type AS event, ts AS t FROM events
UNION ALL SELECT 'engine:start', min(ts) FROM events UNION ALL SELECT 'engine:stop', max(ts) FROM events) GROUP BY event""")
def lifecycle_events(spark, sf_dir):
    made = temporal.with_lifecycle(load_events(spark, sf_dir))
    return made.groupBy("event").agg(F.count("*").alias("n"), F.min("at").alias("first_at")).withColumns(ntz("first_at"))


# --- model, actions, sources --------------------------------------------------------------------------------------------

@query("""SELECT event_id, CASE WHEN abs(epoch(date_trunc('second', TIMESTAMP '2024-01-15')) - epoch(date_trunc('second', ts))) > 600 THEN TIMESTAMP '2024-01-15' ELSE ts END AS effective FROM events""")
def time_variance_correction(spark, sf_dir):
    now = F.expr("timestamp'2024-01-15 00:00:00'")
    return load_events(spark, sf_dir).select("event_id", fn.effective_time(F.col("ts"), now).alias("effective")).withColumns(ntz("effective"))


@query("SELECT event_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || '+00:00' AS datetime FROM events")
def event_serialise(spark, sf_dir):
    return load_events(spark, sf_dir).select("event_id", fn.rfc3339(F.col("ts")).alias("datetime"))


def _registry():
    r = actions.Registry()
    k = {"type": "object", "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 79}}, "required": ["k"], "additionalProperties": False}
    r.register("purchase", schema=k)
    r.register("click")
    return r


CODES = "CASE WHEN event_type NOT IN ('purchase', 'click') THEN -1 WHEN event_type = 'purchase' AND NOT (try_cast(json_extract_string(props, '$.k') AS INTEGER) BETWEEN 0 AND 79) THEN -32602 END"


def _done(**_):
    return None


def _dispatched(spark, sf_dir):
    return _registry().dispatch(load_events(spark, sf_dir).select("event_id", F.col("event_type").alias("cmd"), F.col("props").alias("vars")))


@query(f"SELECT event_type AS cmd, {CODES} AS code, count(*) AS n FROM events GROUP BY ALL")
def action_dispatch(spark, sf_dir):
    return _dispatched(spark, sf_dir).groupBy("cmd", "code").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type AS cmd FROM events WHERE event_type NOT IN ('purchase', 'click')")
def action_undefined(spark, sf_dir):
    return _dispatched(spark, sf_dir).where(f"code = {actions.UNDEFINED}").select("event_id", "cmd")


@query(f"SELECT event_id FROM events WHERE {CODES} = -32602")
def action_schema_validation(spark, sf_dir):
    return _dispatched(spark, sf_dir).where(f"code = {actions.INVALID_PARAMS}").select("event_id")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 2 ELSE (event_id % 3 - 1)::INTEGER END AS code FROM events
WHERE event_id % 5 = 0 OR (event_id % 5 = 1 AND event_id % 3 >= 1)""")
def action_retry_set(spark, sf_dir):
    i = F.col("event_id")
    status = F.when(i % 5 == 0, "inflight").when(i % 5 == 1, "errored").otherwise("completed")
    rows = load_events(spark, sf_dir).select("event_id", status.alias("status"), (i % 3 - 1).cast("int").alias("code"))
    return actions.to_retry(rows).select("event_id", "code")


@query("SELECT event_id, event_type FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events)")
def checkpoint_resume(spark, sf_dir):
    """A source goes on after the checkpoint that an earlier registry has saved."""
    e, store = load_events(spark, sf_dir), Store(spark, folder(spark, "checkpoints"))
    SourceRegistry(store).checkpoint("events", e.agg(F.expr("max(event_id) div 2")).first()[0])
    later = SourceRegistry(store)
    later.register("events", lambda spark, env, after: resume(e, after))
    return later.run(spark, "events").select("event_id", "event_type")


@query(f"SELECT event_type AS cmd, CASE WHEN {CODES} IS NULL THEN 'completed' ELSE 'errored' END AS status, {CODES} AS code, count(*) AS n FROM events GROUP BY ALL")
def action_sink(spark, sf_dir):
    """Actions run from a batch, each with its outcome in the status table."""
    registry = _registry()
    for name in ("purchase", "click"):
        registry.register(name, _done, registry.actions[name].schema)
    to = folder(spark, "status")
    registry.sink(to)(load_events(spark, sf_dir).select(F.col("event_type").alias("cmd"), F.col("props").alias("vars")), 0)
    schema = "cmd string, vars string, status string, code int, message string, batch int"
    return spark.read.schema(schema).parquet(to).groupBy("cmd", "status", "code").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_orderdate FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey
AND l.l_shipdate >= o.o_orderdate AND l.l_shipdate <= o.o_orderdate + INTERVAL 30 DAY)""")
def orders_placed_unshipped(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    within = (line["l_shipdate"] >= o["o_orderdate"]) & (line["l_shipdate"] <= o["o_orderdate"] + F.expr("interval 30 days"))
    return o.join(line, (o["o_orderkey"] == line["l_orderkey"]) & within, "left_anti")


# --- streams ------------------------------------------------------------------------------------------------------------

@query(f"{TWO} SELECT event_id AS first_id, nid AS last_id FROM a WHERE nts <= deadline")
def stream_sequence(spark, sf_dir):
    """The exact engine in keyed state over a file stream."""
    made = available(streaming.run(events_stream(spark, sf_dir), [SIGNUP_BUY], "user_id"), "stream-sequence")
    return made.where("phase = 'complete'").select("first_id", "last_id")


@query("""SELECT date_trunc('hour', ts) AS start, count(*) AS n_events FROM events GROUP BY ALL
HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)""")
def stream_counts(spark, sf_dir):
    """Hours that the watermark has closed."""
    return available(streaming.counts(events_stream(spark, sf_dir), "1 hour"), "stream-counts").withColumns(ntz("start"))


@query(f"SELECT * FROM ({SESSIONS}) WHERE last_ts + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events WHERE event_type IN ('click', 'view'))")
def stream_sessions(spark, sf_dir):
    made = streaming.sessions(events_stream(spark, sf_dir), {"click", "view"}, "user_id", "12 hours")
    return available(made, "stream-sessions").withColumns(ntz("first_ts", "last_ts"))
