"""Gate, audit, settings, call log and replay."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import Observation, functions as F

from textsluice.functions.rules import Policy, POLICIES
from textsluice.operators import access, audit
from textsluice.operators.config import FIELDS, Config, config_history, config_intervals
from textsluice.operators.gate import detailed_gate, gate
from textsluice.operators.intervals import interval_join, running_last, running_total
from textsluice.plans import catalog as c
from textsluice.plans.replay import replay
from textsluice.sources import sinks
from textsluice.sources.calls import parse_calls, read_lines, rejected_lines, tool_calls
from textsluice.sources.sinks import append_audit, newest_events

T0 = dt.datetime(2024, 1, 1)


def requests(spark, *rows):
    """(user, second, text)"""
    return spark.createDataFrame(
        [(i, T0 + dt.timedelta(seconds=s), u, t) for i, (u, s, t) in enumerate(rows)],
        "seq long, ts timestamp, user_id string, text string")


def test_order_of_stages_and_quota(spark):
    df = requests(spark, ("a", 0, "jailbreak"), ("a", 1, "../../"), ("a", 2, "fine"), ("a", 61, "; ls"), (None, 0, None),
                  ("b", 0, "jailbreak ../../"))
    rows = gate(df, Config(max_requests_per_minute=2)).orderBy("seq").collect()
    assert [r.code for r in rows] == ["VALIDATION_ERROR", "POLICY_VIOLATION", "RATE_LIMIT", None, None, "VALIDATION_ERROR"]
    assert rows[2].reason == "Rate limit exceeded, retry after 59s"
    assert [(r.n_violations, r.n_policy_violations, r.n_warnings) for r in rows] == [
        (1, None, None), (0, 1, 0), (None, None, None), (0, 0, 1), (0, 0, 0), (1, None, None)]
    assert rows[4].user_id == "anonymous"
    assert len({r.request_id for r in rows}) == 6


def test_detail(spark):
    df = requests(spark, ("a", 0, "mail a@b.co"), ("a", 1, "../../"), ("a", 2, "x"))
    rows = detailed_gate(df, Config(max_requests_per_minute=2)).orderBy("seq").collect()
    assert rows[0].validation.sanitized == "mail [REDACTED_Email]" and rows[0].policy is None
    assert rows[1].validation.valid and rows[1].policy.violations[0].policy == "no_path_traversal"
    assert rows[2].validation is None and rows[2].policy is None
    off = detailed_gate(df, Config(enable_input_validation=False, enable_policy_enforcement=False,
                                   enable_rate_limiting=False)).collect()
    assert all(r.allowed and r.validation is None and r.policy is None for r in off)


def test_verdict_json(spark):
    df = requests(spark, ("a", 0, "fine"), ("a", 1, "jailbreak"), ("a", 2, "x"))
    out = detailed_gate(df, Config(max_requests_per_minute=2)).orderBy("seq").select(sinks.verdict_json())
    ok, bad, limited = [json.loads(r[0]) for r in out.collect()]
    assert set(ok) == {"allowed", "request_id", "validation", "policy"} and ok["policy"]["allowed"] is True
    assert bad["code"] == "VALIDATION_ERROR" and bad["policy"] is None
    assert bad["validation"]["violations"][0]["severity"] == "critical"
    assert limited["validation"] is None and limited["reason"] == "Rate limit exceeded, retry after 59s"


@pytest.fixture(scope="module")
def log(spark):
    kinds = ["INPUT_PROCESSED", "INPUT_BLOCKED", "POLICY_VIOLATION", "RATE_LIMIT_EXCEEDED", "OUTPUT_FILTERED", "blocked"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("id") % 6 + 1).cast("int"))
    return spark.range(10_500).select(
        F.col("id").alias("seq"), audit.event_id(F.col("id"), "audit").alias("id"), kind.alias("event_type"),
        F.timestamp_seconds(F.col("id") * 60 + 1_704_067_200).alias("ts"), F.lit("ok").alias("details"),
        F.concat(F.lit("u"), F.col("id") % 3).alias("user_id"))


def test_logs(spark, log):
    assert audit.retained(log).agg(F.min("seq")).first()[0] == 500
    assert [r.seq for r in audit.get_logs(log, limit=2).collect()] == [10_499, 10_498]
    assert audit.get_logs(log).count() == 50 and audit.get_logs(log, limit=-1).count() == 50
    assert audit.get_logs(log, limit=1.5).count() == 50 and audit.get_logs(log, limit=0).count() == 0
    assert audit.get_logs(log, "INPUT_BLOCKED", 10**6).count() == sum(i % 6 == 1 for i in range(500, 10_500))
    assert audit.get_logs(log, "nothing").count() == 0
    early = audit.get_logs(log, None, 10, user_id="u1", start="2024-01-01 00:00:00", end="2024-01-01 00:10:00", keep=None)
    assert [r.seq for r in early.collect()] == [7, 4, 1]


def test_totals_and_rollup(spark, log):
    t = audit.totals(log).first()
    assert (t.total_requests, t.blocked_requests) == (10_500, 5_250)      # lower-case "blocked" does not count
    stats = audit.get_stats(log, log, Config(max_requests_per_minute=7)).first()
    assert (stats.active_users, stats.total_requests, stats.max_requests_per_minute) == (3, 10_500, 7)
    rolled = audit.rollup(log, every="1 day").orderBy("window_start").first()
    assert (rolled.events, rolled.blocked, rolled.rate_limit_hits, rolled.block_rate) == (1_440, 720, 240, 0.5)


def test_audit_sink_and_rotation(spark, log, tmp_path):
    sinks.append_audit(log, str(tmp_path / "audit"))
    back = sinks.read_audit(spark, str(tmp_path / "audit"))
    assert back.count() == 10_500 and back.columns == audit.COLUMNS
    spark.sql(f"CREATE DATABASE IF NOT EXISTS rot LOCATION '{tmp_path}/db'")
    sinks.audit_table(log, "rot.audit")
    assert sinks.drop_days_before(spark, "rot.audit", "2024-01-05") == 4
    assert spark.table("rot.audit").agg(F.min("day").cast("string")).first()[0] == "2024-01-05"
    spark.sql("DROP DATABASE rot CASCADE")


def test_config_history(spark):
    schema = "seq long, max_requests_per_minute long, max_tokens_per_request long, enable_input_validation boolean"
    df = spark.createDataFrame([(5, 3, None, None), (1_500_000, None, -1, False), (2_600_000, 0, 9, None)], schema)
    rows = config_history(df).orderBy("seq").collect()
    assert [(r.max_requests_per_minute, r.max_tokens_per_request, r.enable_input_validation) for r in rows] == [
        (3, 100_000, True), (3, 100_000, False), (3, 9, False)]
    spans = sorted((r.from_seq or -1, r.to_seq) for r in config_intervals(config_history(df)).collect())
    assert spans == [(-1, 6), (6, 1_500_001), (1_500_001, 2_600_001), (2_600_001, None)]
    none = config_intervals(config_history(df.where("seq < 0"))).collect()
    assert [(r.from_seq, r.to_seq, r.max_requests_per_minute) for r in none] == [(None, None, 60)]


def test_interval_join(spark):
    iv = spark.createDataFrame([(None, 10, "a"), (10, 20, "b"), (15, 15, "empty"), (5, 30, "c"), (1_000, None, "d")],
                               "from_seq long, to_seq long, name string")
    rows = spark.range(0, 1_200, 1).withColumnRenamed("id", "at")
    got = {(r.at, r.name) for r in interval_join(rows, "at", iv, how="inner").collect()}
    want = {(i, n) for i in range(1_200) for f, t, n in [(-1, 10, "a"), (10, 20, "b"), (15, 15, "e"), (5, 30, "c"), (1_000, 10**9, "d")]
            if f <= i < t}
    assert got == want
    outer = interval_join(rows, "at", iv)
    assert outer.where("name is null").count() == 1_000 - 30
    assert interval_join(rows, "at", iv, how="left_anti").count() == 970
    assert interval_join(rows, "at", iv, how="left_semi").count() == 230
    assert interval_join(rows, "at", iv.limit(0)).count() == 1_200
    plan = interval_join(rows, "at", iv)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlapping_and_clustered_intervals(spark):
    """Long, open, nested and clustered intervals, by key and as a semi join."""
    rng = random.Random(5)
    iv = [(rng.randrange(10**6), 0) for _ in range(150)] + [(5_000 + rng.randrange(50), 0) for _ in range(150)]
    iv = [(a, a + rng.choice([1, 2, 3, 64, 1_000, 300_000]), rng.choice("xy")) for a, _ in iv] + [(None, 9, "x"), (999_000, None, "y"), (7, 7, "x")]
    at = [(rng.randrange(-5, 1_100_000), rng.choice("xy")) for _ in range(300)] + [(5_000 + i, "x") for i in range(60)]
    rows, spans = spark.createDataFrame(at, "at long, k string"), spark.createDataFrame(iv, "from_seq long, to_seq long, k string")

    def holds(a, f, t):
        return (f is None or a >= f) and (t is None or a < t)
    spans = spans.withColumn("f", F.col("from_seq")).withColumn("t", F.col("to_seq"))
    got = sorted((r.at, r.k, str(r.f), str(r.t)) for r in interval_join(rows, "at", spans, how="inner", on=("k",)).collect())
    assert got == sorted((a, k, str(f), str(t)) for a, k in at for f, t, j in iv if j == k and holds(a, f, t))
    semi = sorted((r.at, r.k) for r in interval_join(rows, "at", spans.select("from_seq", "to_seq"), how="left_semi").collect())
    assert semi == sorted((a, k) for a, k in at if any(holds(a, f, t) for f, t, _ in iv))


def test_running_values(spark):
    df = spark.range(50).select(F.col("id").alias("seq"), F.when(F.col("id") % 13 == 5, F.col("id")).alias("v"))
    got = [r.v for r in running_last(df, "seq", ["v"], blocks=7).orderBy("seq").collect()]
    assert got == [None if i < 5 else (i - 5) // 13 * 13 + 5 for i in range(50)]
    total = running_total(df.withColumn("k", F.col("seq") % 2), ["k"], "seq", "seq", slot_us=5)
    assert [r.running for r in total.orderBy("seq").collect()] == [i // 2 + 1 for i in range(50)]


LINES = [
    '{"jsonrpc":"2.0","method":"tools/call","params":{"name":"validate_input","arguments":{"text":5,"user_id":"x","policy_names":[]}}}',
    "", "   ", "junk", '{"jsonrpc":"2.0","method":"a"} tail', '{"jsonrpc":"2.0","method":"a"},{"b":1}',
    '{"jsonrpc":"2.0","method":"a"}]', '{"jsonrpc":2,"method":"a"}', '{"method":"a"}', "[1]", "5",
    '{"jsonrpc":"2.0","method":"m","params":5}',
    '{"jsonrpc":"2.0","method":"tools/call"}',
    '{"jsonrpc":"2.0","method":"tools/call","params":{"name":"get_audit_logs","arguments":{"limit":1.0,"event_type":"X","policy_names":["a",1],"enable_rate_limiting":"no"}}}',
    '{"jsonrpc":"2.0","method":"tools/call","params":{"name":"get_audit_logs","arguments":{"limit":0,"user_id":7,"policy_names":["a",null],"enable_rate_limiting":false}}}',
    '{"jsonrpc":"2.0","method":"tools/call","params":{"name":"check_policy","arguments":{"limit":-3,"policy_names":["a","b"],"max_requests_per_minute":-1}}}',
]


def test_call_log(spark, tmp_path):
    path = tmp_path / "calls.jsonl"
    path.write_bytes("\n".join(LINES).encode() + b'\n{"jsonrpc":"2.0","method":"\xff"}\n')
    assert parse_calls(read_lines(spark, str(path))).count() == 6
    df = spark.createDataFrame(list(enumerate(LINES)), "seq long, value string")
    parsed = parse_calls(df)
    assert sorted(r.seq for r in parsed.collect()) == [0, 11, 12, 13, 14, 15]
    rows = {r.seq: r for r in tool_calls(parsed).collect()}
    assert (rows[0].text, rows[0].user_id, rows[0].policy_names, rows[0].known) == ("", "x", [], True)
    assert (rows[12].tool, rows[12].known, rows[12].action) == ("", False, "block")
    assert (rows[13].limit, rows[13].event_type, rows[13].policy_names, rows[13].enable_rate_limiting) == (50, "X", None, None)
    assert (rows[14].limit, rows[14].user_id, rows[14].policy_names, rows[14].enable_rate_limiting) == (0, "anonymous", None, False)
    assert (rows[15].limit, rows[15].policy_names, rows[15].max_requests_per_minute) == (50, ["a", "b"], None)


def _call(tool, **arguments):
    return json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": tool, "arguments": arguments}})


REPLAY = [
    _call("validate_input", text="foo", user_id="u"),
    _call("add_policy", name="p", pattern="foo", action="block"),
    _call("validate_input", text="foo", user_id="u"),
    _call("add_policy", name="p", pattern="(", action="block"),
    _call("add_policy", name="p", pattern="x", action="deny"),
    _call("check_policy", text="foo <!ENTITY", policy_names=["p"]),
    _call("add_policy", name="p", pattern="foo", action="warn"),
    _call("check_policy", text="foo <!ENTITY"),
    _call("update_config", max_requests_per_minute=2, enable_output_filtering=False),
    _call("validate_input", text="foo", user_id="u"),
    _call("filter_output", text="a@b.co"),
    _call("update_config", enable_rate_limiting=False, enable_output_filtering=True),
    _call("validate_input", text="foo", user_id="u"),
    _call("filter_output", text="a@b.co"),
    _call("remove_policy", name="p"),
    _call("update_config", enable_rate_limiting=True, max_requests_per_minute=3),
    _call("validate_input", text="foo", user_id="u"),
    _call("validate_input", text="foo", user_id="u"),
]


def test_replay(spark):
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i), v) for i, v in enumerate(REPLAY)],
                               "seq long, ts timestamp, value string")
    out = replay(tool_calls(parse_calls(df)))
    got = {r.seq: r for r in out.verdicts.collect()}
    assert {s: r.code for s, r in got.items()} == {
        0: None, 2: "POLICY_VIOLATION", 9: "RATE_LIMIT", 12: None, 16: None, 17: "RATE_LIMIT"}
    assert [h.policy for h in got[12].policy_hits] == ["p"] and got[12].n_warnings == 1 and got[16].policy_hits == []
    checks = {r.seq: r for r in out.checks.collect()}
    assert not checks[5].allowed and [h.policy for h in checks[5].policy_hits] == ["p"]
    assert not checks[7].allowed and [h.policy for h in checks[7].policy_hits] == ["no_xxe", "p"]
    outputs = {r.seq: r for r in out.outputs.collect()}
    assert (outputs[10].modified, outputs[10].redacted, outputs[10].redactions) == (False, "a@b.co", None)
    assert (outputs[13].modified, outputs[13].redacted) == (True, "[REDACTED_EMAIL]")
    events = {r.seq: (r.event_type, r.details, r.user_id) for r in out.audit.collect()}
    assert events == {0: ("INPUT_PROCESSED", "ok", "u"), 2: ("POLICY_VIOLATION", "1 violations", "u"),
                      9: ("RATE_LIMIT_EXCEEDED", "retry_after=52s", "u"), 12: ("INPUT_PROCESSED", "ok", "u"),
                      13: ("OUTPUT_FILTERED", "1 redactions", "system"), 16: ("INPUT_PROCESSED", "ok", "u"),
                      17: ("RATE_LIMIT_EXCEEDED", "retry_after=44s", "u")}


def test_access(spark):
    urls = spark.createDataFrame([(1, "https://a.org/x"), (2, "http://b.org"), (3, "no url"), (4, "https://sub.a.org/")], "i int, url string")
    domains = spark.createDataFrame([("a.org",)], "domain string")
    assert sorted((r.i, r.host) for r in access.outside_allowlist(urls, domains).collect()) == [(2, "b.org"), (3, None), (4, "sub.a.org")]
    calls = spark.createDataFrame([(1, "drop", "/x", "u"), (2, "write", "/x", None), (3, "read", "/etc/p", "u"), (4, "read", "/x", "u"), (5, "write", "/x", "u")],
                                  "i int, tool string, path string, user_id string")
    out = access.forbidden_calls(calls, dangerous_tools=["drop"], destructive_tools=["write"], sensitive_paths=["/etc/"])
    assert {r.i: r.refusal for r in out.collect()} == {1: "dangerous_tool", 2: "unauthenticated", 3: "sensitive_path", 4: None, 5: None}


def test_rejected_lines(spark, tmp_path):
    path = tmp_path / "calls.jsonl"
    path.write_bytes("\n".join(LINES).encode() + b'\n{"jsonrpc":"2.0","method":"\xff"}\n')
    lines = read_lines(spark, str(path))
    found = rejected_lines(lines)
    counts = {r["reason"]: r["count"] for r in found.groupBy("reason").count().collect()}
    assert counts == {"encoding": 1, "json": 4, "shape": 4} and found.columns == ["value", "reason"]
    seen = Observation("lines")
    assert parse_calls(lines, observation=seen).count() == 6
    assert seen.get == {"calls": 6, **counts}


@pytest.mark.parametrize("shuffled", [False, True])
def test_newest_events_read_few_days(spark, tmp_path, shuffled):
    """Whether or not days follow seq, the newest entries come back."""
    day = F.col("id") % 10 if shuffled else F.floor(F.col("id") / 100)
    log = spark.range(1000).select(F.col("id").alias("seq"), F.lit("i").alias("id"), F.lit("t").alias("event_type"), F.timestamp_seconds(day * 86_400).alias("ts"),
                                   F.lit("d").alias("details"), F.lit("u").alias("user_id"))
    append_audit(log, str(tmp_path / "log"))
    newest = newest_events(spark, str(tmp_path / "log"), 150)
    assert sorted(r.seq for r in newest.collect()) == list(range(850, 1000))
    assert newest_events(spark, str(tmp_path / "log"), 5000).count() == 1000
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert shuffled or re.findall(r"1970-\d\d-\d\d", plan.split("PartitionFilters: [")[1].split("]")[0]) == ["1970-01-09", "1970-01-10"]


def test_gate_by_keys(spark, sf):
    """Keys read apart from the texts give the same verdicts; refused requests alone are joined."""
    config = Config(max_requests_per_minute=2)
    reqs, keys = c.requests(spark, sf), c.request_keys(spark, sf)
    for run in (gate, detailed_gate):
        one, other = run(reqs, config, window_us=c.DAY_US), run(reqs, config, window_us=c.DAY_US, keys=keys)
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    codes = {r.code for r in other.collect()}
    assert "RATE_LIMIT" in codes and None in codes
    off = detailed_gate(reqs, Config(enable_rate_limiting=False), window_us=c.DAY_US)
    assert off.where("code = 'RATE_LIMIT'").count() == 0


def test_rows_copied_per_width_are_never_broadcast(spark):
    """Rows look narrow to Spark's estimate, but are copied for every width of interval."""
    rows = spark.range(0, 3_000, 1, 2).withColumnRenamed("id", "at")
    iv = spark.range(4_000).select(F.col("id").alias("from_seq"), (F.col("id") + F.pow(F.lit(2), F.col("id") % 11).cast("long")).alias("to_seq"),
                                   *[F.concat(F.lit("n" * 200), "id").alias(f"n{k}") for k in range(8)])
    for part, joins in ((iv, "SortMergeJoin"), (iv.where("from_seq < 500"), "BroadcastHashJoin")):
        joined = interval_join(rows, "at", part, how="inner")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joins in plan and "BuildLeft" not in plan
        assert joined.count() == sum(max(0, min(3_000, r.to_seq) - r.from_seq) for r in part.select("from_seq", "to_seq").collect())


def test_one_block_is_no_literal(spark):
    """A small axis is one block; joins on it stay equi-joins."""
    rows = spark.createDataFrame([(None,), (0,), (7,)], "us long")
    semi = interval_join(rows, "us", spark.createDataFrame([(-5, 3), (-2, 1)], "a long, b long"), start="a", stop="b", how="left_semi")
    plan = semi._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and [r.us for r in semi.collect()] == [0]
