"""Answers as of points in an ordered log, against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textsluice.operators import audit, intervals
from textsluice.plans.replay import replay, replay_batches
from textsluice.sources.calls import parse_calls, tool_calls

TYPES = ["INPUT_PROCESSED", "INPUT_BLOCKED", "RATE_LIMIT_EXCEEDED", "OUTPUT_FILTERED"]


@pytest.fixture(params=[(250_000, 64), (9, 4), (1, 1)])
def blocks(request, monkeypatch):
    monkeypatch.setattr(intervals, "BLOCK_ROWS", request.param[0])
    monkeypatch.setattr(intervals, "MOST_BLOCKS", 50)
    monkeypatch.setattr(audit, "RANKS", request.param[1])


def a_log(n: int):
    """Events and questions on one axis: clustered, with one hot type."""
    r, at, events, asks = random.Random(3), 0, [], []
    for _ in range(n):
        at += r.choice([1, 1, 1, 500])
        if r.random() < 0.2:
            asks.append((at, r.choice([None, "NONE", *TYPES]), r.choice([0, 1, 3, 17, 10_000])))
        else:
            events.append((at, f"id{at}", r.choice(TYPES[:1] * 5 + TYPES), f"u{r.randrange(20)}"))
    return events, asks


def frame(spark, events):
    return spark.createDataFrame(events, "seq long, id string, event_type string, user_id string").select(
        "seq", "id", "event_type", F.timestamp_seconds("seq").alias("ts"), F.lit("d").alias("details"), "user_id")


def test_logs_as_of(spark, blocks):
    events, asks = a_log(300)
    wanted = spark.createDataFrame(asks, "seq long, event_type string, limit long")
    got = {(r.ask, r.position, r.seq, r.id) for r in audit.logs_as_of(frame(spark, events), wanted, keep=40).collect()}
    want = set()
    for at, kind, limit in asks:
        held = [e for e in events if e[0] < at][-40:][::-1]
        want |= {(at, i, e[0], e[1]) for i, e in enumerate([e for e in held if kind in (None, e[2])][:limit])}
    assert got == want and len(want) > 200


def test_counters_as_of(spark, blocks):
    events, asks = a_log(300)
    first = {}
    for at, _, _, user in events:
        first.setdefault(user, at)
    seen = spark.createDataFrame([(at, u) for u, at in first.items()], "seq long, user_id string")
    wanted = spark.createDataFrame([(a,) for a, _, _ in asks], "seq long")
    got = {tuple(r) for r in audit.counters_as_of(frame(spark, events), seen, wanted).collect()}
    assert got == {(at, sum(f < at for f in first.values()), sum(e[0] < at for e in events),
                    sum(e[0] < at and e[2] in TYPES[1:3] for e in events)) for at, _, _ in asks}


def test_nothing_asked_or_logged(spark, blocks):
    events, asks = a_log(30)
    none = spark.createDataFrame([], "seq long, event_type string, limit long")
    assert audit.logs_as_of(frame(spark, events), none).count() == 0
    assert audit.logs_as_of(frame(spark, events).limit(0), spark.createDataFrame(asks, none.schema)).count() == 0
    zero = audit.counters_as_of(frame(spark, events).limit(0), none.select("seq"), spark.createDataFrame([(5,)], "seq long")).collect()
    assert [tuple(r) for r in zero] == [(5, 0, 0, 0)]


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_running_sums(spark, blocks, keys):
    rows = [(i * i % 101, i, i % 4, ["a", "b", "a"][i % 3]) for i in range(101)]
    df = spark.createDataFrame(rows, "at long, i long, v long, k string").dropDuplicates(["at"])
    have = [r.asDict() for r in df.collect()]
    got = {(r["at"], r["v"]) for r in intervals.running_sums(df, "at", ["v"], keys=keys).collect()}
    assert got == {(r["at"], sum(o["v"] for o in have if o["at"] <= r["at"] and all(o[k] == r[k] for k in keys))) for r in have}


def test_blocks_follow_rows(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BLOCK_ROWS", 100)
    sizes = [r["count"] for r in intervals.in_blocks(spark.range(1000), "id").groupBy("_block").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 110
    assert intervals.in_blocks(spark.range(50), "id").select("_block").distinct().count() == 1
    assert intervals.in_blocks(spark.range(0), "id").count() == 0


def call(tool, **arguments):
    return json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": tool, "arguments": arguments}})


def test_log_in_batches(spark, tmp_path):
    """Settings, policies and stamps carry over from batch to batch."""
    lines = [
        [call("validate_input", text="foo", user_id="u"), call("add_policy", name="p", pattern="foo", action="block"),
         call("validate_input", text="foo", user_id="u"), call("update_config", max_requests_per_minute=3)],
        [call("validate_input", text="foo", user_id="u"), call("validate_input", text="foo", user_id="u"), call("check_policy", text="foo"),
         call("remove_policy", name="no_xxe"), "junk", call("add_policy", name="q", pattern="f(o)+", action="warn"), call("filter_output", text="a@b.co")],
        [call("get_stats")],
        [call("check_policy", text="foo <!ENTITY"), call("update_config", enable_rate_limiting=False, enable_output_filtering=False),
         call("validate_input", text="ok", user_id="u"), call("filter_output", text="a@b.co"), call("add_policy", name="p", pattern="foo", action="warn"),
         call("check_policy", text="foo")]]
    every, schema = [], "seq long, ts timestamp, value string"
    for part in lines:
        rows = [(len(every) + i, v) for i, v in enumerate(part)]
        every += rows
        (spark.createDataFrame(rows, "seq long, value string").select("seq", F.timestamp_seconds("seq").alias("ts"), "value")
         .coalesce(1).write.mode("append").parquet(f"{tmp_path}/lines"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/lines")
    replay_batches(source, f"{tmp_path}/run", f"{tmp_path}/cp").awaitTermination()
    whole = replay(tool_calls(parse_calls(spark.read.schema(schema).parquet(f"{tmp_path}/lines"))))
    for name in ("verdicts", "checks", "outputs"):
        want = getattr(whole, name)
        got = spark.read.parquet(f"{tmp_path}/run/{name}").select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count()
    checks = {r.seq: [h.policy for h in r.policy_hits] for r in whole.checks.collect()}
    assert checks == {6: ["p"], 12: ["p", "q"], 17: ["q", "p"]}


def test_questions_in_a_replay(spark):
    lines = [
        call("get_stats"), call("get_audit_logs"),
        call("validate_input", text="ok", user_id="u"), call("filter_output", text="a@b.co"),
        call("get_stats"), call("get_audit_logs", limit=1),
        call("update_config", enable_rate_limiting=False, max_requests_per_minute=1, enable_output_filtering=False),
        call("validate_input", text="<!ENTITY", user_id="v"), call("filter_output", text="a@b.co"),
        call("get_stats"), call("get_audit_logs", event_type="INPUT_PROCESSED", limit=-1),
        call("update_config", enable_rate_limiting=True), call("validate_input", text="ok", user_id="u"), call("validate_input", text="ok"),
        call("get_audit_logs", limit="3"), call("get_stats")]
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, value string").withColumn("ts", F.timestamp_seconds("seq"))
    out = replay(tool_calls(parse_calls(df)), keep=3)
    stats = {r.seq: (r.active_users, r.total_requests, r.blocked_requests, r.enable_rate_limiting, r.max_requests_per_minute) for r in out.stats.collect()}
    assert stats == {0: (0, 0, 0, True, 60), 4: (1, 2, 0, True, 60), 9: (1, 3, 1, False, 1), 15: (2, 5, 2, True, 1)}
    logs = sorted((r.ask, r.position, r.seq, r.event_type) for r in out.logs.collect())
    assert logs == [(5, 0, 3, "OUTPUT_FILTERED"), (10, 0, 2, "INPUT_PROCESSED"),
                    (14, 0, 13, "INPUT_PROCESSED"), (14, 1, 12, "RATE_LIMIT_EXCEEDED"), (14, 2, 7, "POLICY_VIOLATION")]
