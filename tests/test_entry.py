"""The registered queries and their SQL belong together and run."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, compare
from textsluice.plans.catalog import QUERIES, _with_turn, events
from textsluice.plans.oracles import ORACLES
from textsluice.sources.calls import parse_calls, tool_calls


def test_every_query_of_the_catalog_has_sql():
    assert set(QUERIES) == set(ORACLES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_events_go_through_all_user_turns(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'").select("text").distinct()
    ev = events(spark, sf)
    seen = _with_turn(ev, spark, sf)
    assert seen.count() == ev.count()
    assert turns.join(seen, turns.text == seen.turn_text, "left_anti").count() == 0


def test_calls_with_repeated_keys_and_long_texts_stay(spark):
    call = '{"jsonrpc": "2.0", "method": "tools/call", "params": {"name": "validate_input", "arguments": {"text": "a", "text": "%s"}}}'
    lines = spark.createDataFrame([(call % "b",), (call % ("c" * 20_100_000),)], "value string")
    assert sorted(r[0] for r in tool_calls(parse_calls(lines)).selectExpr("length(text)").collect()) == [1, 20_100_000]


@pytest.mark.parametrize("name", ["v_violation_list", "f_redaction_list", "p_subset", "r_default_key", "g_verdict", "a_events", "d_quota"])
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert compare(spark, con, sf, name).startswith("ok")


def test_no_query_pairs_rows_blindly(spark, sf):
    """No nested-loop or Cartesian join in the plans of joined queries."""
    for name in ("g_verdict", "p_rule_join", "p_version_hits", "d_maintenance", "d_allowlist", "d_rbac", "d_quota", "a_stats"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
