"""The limiter against a one-request-at-a-time simulation."""

import collections

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from textsluice.operators.limiter import _cut_hot_users, active_users, admit, rate_limit

S = 1_000_000


def simulate(rows, window=60 * S):
    """rows: (seq, us, user, cap) -> {seq: (limited, retry_after)}"""
    kept, out = collections.defaultdict(list), {}
    for seq, us, user, cap in sorted(rows, key=lambda r: (r[1], r[0])):
        live = [t for t in kept[user] if us - t < window]
        if len(live) >= cap:
            out[seq] = (True, (window - (us - live[0])) // S + 1)
        else:
            live.append(us)
            out[seq] = (False, None)
        kept[user] = live
    return out


def run(spark, rows, window=60 * S, **options):
    df = spark.createDataFrame(rows, "seq long, us long, user_id string, cap long")
    cap = options.pop("max_requests", F.col("cap"))
    got = rate_limit(df, max_requests=cap, window_us=window, ts="us", **options)
    return {r.seq: (r.limited, r.retry_after) for r in got.collect()}


def test_edges(spark):
    rows = [(0, 0, "a", 1), (1, 0, "a", 1), (2, 59 * S + 999_999, "a", 1), (3, 60 * S, "a", 1), (4, 60 * S, "b", 1),
            (5, 0, None, 1), (6, 1, "anonymous", 1), (7, 0, "", 1)]
    assert run(spark, rows) == {
        0: (False, None), 1: (True, 61), 2: (True, 1), 3: (False, None), 4: (False, None),
        5: (False, None), 6: (True, 60), 7: (False, None)}


def test_zero_is_refused(spark):
    with pytest.raises(ValueError):
        run(spark, [(0, 0, "a", 1)], max_requests=0)


def test_rejected_requests_use_no_quota(spark):
    rows = [(i, i * 10 * S, "a", 2) for i in range(20)]
    assert run(spark, rows) == simulate([(s, us, u, c) for s, us, u, c in rows])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 4)), max_size=60), st.integers(1, 30))
def test_admit_is_sequential(steps, window):
    us, now = [], 0
    for gap, _ in steps:
        now += gap % 9
        us.append(now)
    caps = [cap for _, cap in steps]
    want = simulate([(i, t * S, "u", c) for i, (t, c) in enumerate(zip(us, caps))], window * S)
    times, limits = np.array(us, dtype=np.int64) * S, np.array(caps, dtype=np.int64)
    for cut in {0, len(us) // 2, len(us)}:        # also from a carried state
        first = admit(times[:cut], limits[:cut], [], window * S)
        second = admit(times[cut:], limits[cut:], first[2], window * S)
        limited, retry = np.concatenate([first[0], second[0]]), np.concatenate([first[1], second[1]])
        assert [(bool(a), int(b) if a else None) for a, b in zip(limited, retry)] == [want[i] for i in range(len(us))]


def _traffic(seed, n, users, span, caps):
    rng = np.random.default_rng(seed)
    hot = rng.random(n) < 0.4
    who = np.where(hot, 0, rng.integers(1, users, n))
    us = rng.integers(0, span, n)
    return [(i, int(us[i]) * S, f"u{who[i]}", int(caps[(us[i] * len(caps)) // span])) for i in range(n)]


@pytest.mark.parametrize("span, caps", [(40_000, [3]), (3_000, [4]), (20_000, [5, 1, 3])])
def test_hot_user_in_chunks(spark, span, caps):
    """Light, saturated and changing limits; one user holds 40 % of the rows."""
    rows = _traffic(7, 1_500, 30, span, caps)
    want = simulate(rows)
    assert any(limited for limited, _ in want.values())
    assert run(spark, rows) == want
    assert run(spark, rows, hot_rows=150, lookahead=2 if span == 3_000 else 64) == want


def test_burst_in_one_instant_is_cut_by_rows(spark):
    """No chunk is larger than asked for, and odd limits and times are defined."""
    rows = [(i, 5 * S, "u", 3) for i in range(1_000)] + [(1_000, 90 * S, "u", 3)]
    assert run(spark, rows, hot_rows=100) == simulate(rows)
    df = spark.createDataFrame(rows, "_seq long, _us long, _user string, _cap long").withColumn("_chunk", F.lit(0).cast("long"))
    sizes = [r["count"] for r in _cut_hot_users(df, 1_001, 100).groupBy("_user", "_chunk").count().collect()]
    assert max(sizes) <= 100 and sum(sizes) == 1_001
    odd = spark.createDataFrame([(0, None, "v", 0), (1, None, "v", None), (2, 5, "v", -1)], "seq long, us long, user_id string, cap long")
    assert [r.limited for r in rate_limit(odd, max_requests=F.col("cap"), ts="us").collect()] == [False] * 3


def test_batches_of_one_row(spark):
    rows = _traffic(3, 400, 10, 3_000, [2])
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "3")
    try:
        assert run(spark, rows) == simulate(rows)
    finally:
        spark.conf.set(size, before)


def test_property_never_more_than_max_admitted(spark):
    rows = _traffic(11, 1_000, 8, 2_000, [3])
    got = run(spark, rows)
    by_user = collections.defaultdict(list)
    for seq, us, user, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        live = [t for t in by_user[user] if us - t < 60 * S]
        assert got[seq][0] == (len(live) >= 3)
        if not got[seq][0]:
            by_user[user].append(us)


def test_tenants_and_active_users(spark):
    df = spark.createDataFrame([(0, 0, "a", "x"), (1, 1, "a", "y"), (2, 2, "a", "x"), (3, 3, None, None)],
                               "seq long, us long, user_id string, t string")
    got = {r.seq: r.limited for r in rate_limit(df, max_requests=1, ts="us", tenant="t").collect()}
    assert got == {0: False, 1: False, 2: True, 3: False}
    assert active_users(df).first()[0] == 2


def test_columns_pass_through_and_plan_has_one_shuffle(spark):
    df = spark.createDataFrame([(0, 0, "a", [1, None], True)], "seq long, us long, user_id string, m array<bigint>, f boolean")
    out = rate_limit(df.withColumn("at", F.timestamp_micros("us")), ts="us")
    row = out.first()
    assert row.m == [1, None] and row.f is True and row.at is not None and row.limited is False
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
