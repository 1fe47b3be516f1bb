"""The registered queries: every operator over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import detect, policy as pol
from ..functions.matching import exploded
from ..functions.redact import redact
from ..functions.rules import POLICIES, Policy, Rule
from ..operators import access, audit
from ..operators.config import Config, config_history
from ..operators.gate import (detailed_gate, gate, limit_requests, policy_counts, screen_requests, settings_of,
                              verdict_columns)
from ..operators.limiter import HOT_ROWS, active_users, micros, rate_limit
from ..operators.policies import (apply_changes, policy_hits, policy_hits_from_table, policy_table,
                                  policy_versions, version_hits)
from ..session import ensure_checkpoint_dir
from ..sources import sinks
from ..sources.calls import parse_calls, rejected_lines, tool_calls
from ..sources.tables import spread, table
from ..streaming.gate import read_committed, read_rollup, second_table, stream_gate, stream_rollup, write_rollup, write_with_handler
from ..streaming.limiter import limit_batches, stream_rate_limit
from .payloads import OUTPUT_PAYLOADS, REQUEST_PAYLOADS, RULE_PAYLOADS, with_payload
from .replay import Replay, replay, replay_batches
from .reports import redaction_report, rule_report, validation_summary

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries, shared with their SQL.  The event
# table has few events per user and minute, so the limiter runs per day.
DAY_US = 86_400_000_000
LIMIT = 3
SHORT_TOKENS = 250
GATE_TOKENS = 60
GATE = Config(max_requests_per_minute=LIMIT, max_tokens_per_request=GATE_TOKENS)
KEEP = 500
ROTATE_BEFORE = "2024-01-15"
EXTRA_POLICIES = (Policy("topsecret_marker", r"(?i)topsecret\b", "redact", "Mark top secret text"),
                  Policy("empty_matches_all", "", "warn", "Everything"))
ALL_POLICIES = (*POLICIES, *EXTRA_POLICIES)
CHANGE_PATTERNS = [r"(?i)pass\w+", r"\d{4}", "(", r"a(?=b)", r"[.][.]/", "jail", ""]
CHANGE_ACTIONS = ["block", "warn", "redact", "deny"]
REPLAY_PATTERNS = [r"(?i)topsecret", "jail", r"(?=x)", r"(?i);\s*ls\b", "[", "hunter", ""]
REPLAY_WINDOW_US = 21_600_000_000
ASKED_TYPES = [None, "INPUT_BLOCKED", "OUTPUT_FILTERED", "RATE_LIMIT_EXCEEDED", "UNHEARD", "POLICY_VIOLATION"]


def _tables(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def documents(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def pages(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "pages"))


def planted(spark, sf) -> DataFrame:
    """Documents with a payload appended: doc_id, lang, source, t."""
    return documents(spark, sf).select("doc_id", "lang", "source", with_payload(
        F.col("text"), F.col("doc_id"), RULE_PAYLOADS).alias("t"))


def events(spark, sf) -> DataFrame:
    _tables(spark)
    return table(spark, sf, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", micros(F.col("ts")).alias("us"))


def _user() -> Column:
    return F.when(F.col("event_id") % 50 != 0, F.col("user_id").cast("string"))


def _user_turns(spark, sf) -> DataFrame:
    """All user turns, numbered in their conversation: conv_id, at, turns, turn_text."""
    turns = W.partitionBy("conv_id")
    return table(spark, sf, "conversations").where("role = 'user'").select(
        "conv_id", F.col("text").alias("turn_text"), (F.row_number().over(turns.orderBy("turn")) - 1).alias("at"),
        F.count("*").over(turns).alias("turns"))


def _with_turn(ev: DataFrame, spark, sf) -> DataFrame:
    """Every event with a user turn: event_id modulo the conversations picks the
    conversation, and the rounds taken so far pick the turn, so the events go
    through all turns of all conversations.  An event whose conversation has no
    user turn has an empty text."""
    n = table(spark, sf, "conversations").agg(F.max("conv_id")).first()[0] + 1
    turns, event = _user_turns(spark, sf), F.col("event_id")
    own = (event % n == turns.conv_id) & (F.floor(event / n) % turns.turns == turns["at"])
    joined = ev.join(turns, own, "left").withColumn("turn_text", F.coalesce("turn_text", F.lit("")))
    return joined.drop("conv_id", "at", "turns")


def as_requests(ev: DataFrame, spark, sf) -> DataFrame:
    ev = ev if ev.isStreaming else spread(ev)
    return _with_turn(ev, spark, sf).select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), _user().alias("user_id"),
        with_payload(F.col("turn_text"), F.col("event_id"), REQUEST_PAYLOADS).alias("text"))


def requests(spark, sf) -> DataFrame:
    return as_requests(events(spark, sf), spark, sf)


def request_keys(spark, sf) -> DataFrame:
    """The same requests without their texts."""
    return events(spark, sf).select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), _user().alias("user_id"))


def verdicts(spark, sf) -> DataFrame:
    return gate(requests(spark, sf), GATE, ALL_POLICIES, window_us=DAY_US, keys=request_keys(spark, sf))


def detailed(spark, sf) -> DataFrame:
    return detailed_gate(requests(spark, sf), GATE, ALL_POLICIES, window_us=DAY_US, keys=request_keys(spark, sf))


def outputs(spark, sf) -> DataFrame:
    """Assistant turns as outputs, numbered below the requests' range."""
    return spread(table(spark, sf, "conversations").where("role = 'assistant'")).select(
        (-(F.col("conv_id") * 100 + F.col("turn")) - 1).alias("seq"),
        F.timestamp_seconds(F.col("conv_id") + 1_704_067_200).alias("ts"),
        with_payload(F.col("text"), F.col("conv_id") + F.col("turn"), OUTPUT_PAYLOADS).alias("text"))


def limited_events(spark, sf, **options) -> DataFrame:
    ev = events(spark, sf).select(F.col("event_id").alias("seq"), "us", F.col("user_id").cast("string").alias("user_id"))
    return rate_limit(ev, max_requests=LIMIT, window_us=DAY_US, ts="us", **options)


def audit_log(spark, sf) -> DataFrame:
    return audit.events_of_verdicts(verdicts(spark, sf)).unionByName(
        audit.events_of_outputs(redact(outputs(spark, sf))))


def _flat_audit(log: DataFrame) -> DataFrame:
    return log.select("seq", "id", "event_type", F.unix_micros("ts").alias("us"), "details", "user_id")


def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


# -- detection -----------------------------------------------------------------
def v_length(spark, sf):
    size = detect.byte_length(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", size.alias("n_bytes"),
                                       detect.too_long(size, SHORT_TOKENS).alias("too_long"))


def _hit_rows(category: str) -> Query:
    def query(spark, sf):
        hit = planted(spark, sf).select("doc_id", detect.input_mask(F.col("t")).alias("m"))
        rows = exploded(hit, ["doc_id"], detect.violations(F.col("m"), F.lit(0).cast("long")), "v")
        return rows.where(F.col("v.category") == category).select("doc_id", "v.description", "v.severity")
    return query


def v_rule_report(spark, sf):
    return rule_report(documents(spark, sf), "lang")


def v_validate_summary(spark, sf):
    return validation_summary(planted(spark, sf), "lang", text="t", max_tokens=SHORT_TOKENS)


def v_violation_list(spark, sf):
    screened = detect.screen(planted(spark, sf).select("doc_id", "t"), "t", SHORT_TOKENS)
    found = detect.violations(F.col("input_mask"), F.col("n_bytes"), SHORT_TOKENS)
    return exploded(screened, ["doc_id"], found, "v", "position").select(
        "doc_id", "position", "v.category", "v.description", "v.severity")


def v_validate(spark, sf):
    v = detect.validate(planted(spark, sf).select("doc_id", "t"), "t", SHORT_TOKENS)
    return v.select("doc_id", "validation.valid", "validation.sanitized",
                    F.size("validation.violations").cast("long").alias("n_violations"))


def v_sanitize(spark, sf):
    masked = planted(spark, sf).withColumn("m", detect.input_mask(F.col("t")))
    return masked.select("doc_id", detect.sanitize(F.col("t"), F.col("m")).alias("sanitized"))


def v_pages_report(spark, sf):
    return rule_report(pages(spark, sf), text="html")


# -- redaction -----------------------------------------------------------------
def f_secret_redact(spark, sf):
    return redact(planted(spark, sf).select("doc_id", "t"), "t", personal=()).select("doc_id", "redacted", "modified")


def f_pii_redact(spark, sf):
    return redact(planted(spark, sf).select("doc_id", "t"), "t", secrets=()).select("doc_id", "redacted", "modified")


def f_redact_text(spark, sf):
    return redact(planted(spark, sf).select("doc_id", "t"), "t").select(
        "doc_id", "redacted", "modified", F.size("redactions").cast("long").alias("n_redactions"))


def f_redaction_list(spark, sf):
    found = redact(planted(spark, sf).select("doc_id", "t"), "t")
    return exploded(found, ["doc_id"], F.col("redactions"), "r", "position").select(
        "doc_id", "position", "r.category",
        F.col("r.original_length").cast("long").alias("original_length"))


def f_report(spark, sf):
    return redaction_report(planted(spark, sf), "lang", text="t")


def f_report_natural(spark, sf):
    return redaction_report(documents(spark, sf), "lang", "source")


def f_report_quality(spark, sf):
    labelled = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return redaction_report(labelled, "quality")


def f_outputs(spark, sf):
    return redact(outputs(spark, sf)).select("seq", "redacted", "modified")


def f_disabled(spark, sf):
    off = redact(outputs(spark, sf), enabled=False)
    return off.select("seq", "redacted", "modified", F.col("redactions").isNull().alias("unlisted"))


def f_extra_kinds(spark, sf):
    kinds = (*access.EXTRA_OUTPUT_RULES,)
    return redact(planted(spark, sf).select("doc_id", "t"), "t", secrets=(), personal=kinds).select(
        "doc_id", "redacted", F.size("redactions").cast("long").alias("n_redactions"))


# -- policies ------------------------------------------------------------------
def p_evaluate(spark, sf):
    masked = planted(spark, sf).withColumn("m", pol.policy_masks(F.col("t"), ALL_POLICIES))
    m = F.col("m")
    return masked.select("doc_id", pol.is_allowed(m, ALL_POLICIES).alias("allowed"),
                         pol.violation_count(m, ALL_POLICIES).alias("n_violations"),
                         pol.warning_count(m, ALL_POLICIES).alias("n_warnings"))


def p_routing(spark, sf):
    checked = pol.check_policy(planted(spark, sf), "t", ALL_POLICIES)
    rows = F.concat(
        F.transform("policy.violations", lambda r: F.struct(F.lit("violation").alias("kind"), r.alias("r"))),
        F.transform("policy.warnings", lambda r: F.struct(F.lit("warning").alias("kind"), r.alias("r"))))
    return exploded(checked, ["doc_id", "policy.allowed"], rows, "x").select(
        "doc_id", "allowed", "x.kind", "x.r.policy", "x.r.action", "x.r.description")


def _subset() -> Column:
    return (F.when(F.col("doc_id") % 4 == 1, F.array().cast("array<string>"))
            .when(F.col("doc_id") % 4 == 2, F.array(F.lit("no_xxe"), F.lit("unknown"), F.lit("no_sql_injection")))
            .when(F.col("doc_id") % 4 == 3, F.array(F.lit("no_command_injection"), F.lit("topsecret_marker"))))


def p_subset(spark, sf):
    masked = planted(spark, sf).withColumn("m", pol.policy_masks(F.col("t"), ALL_POLICIES, _subset()))
    m = F.col("m")
    return masked.select("doc_id", pol.is_allowed(m, ALL_POLICIES).alias("allowed"),
                         pol.violation_count(m, ALL_POLICIES).alias("n_violations"),
                         pol.warning_count(m, ALL_POLICIES).alias("n_warnings"))


def p_hits(spark, sf):
    return policy_hits(planted(spark, sf), "doc_id", text="t", policies=ALL_POLICIES).select(
        "doc_id", "position", "policy", "action", "description")


def p_rule_join(spark, sf):
    return policy_hits_from_table(planted(spark, sf), policy_table(spark, ALL_POLICIES), "doc_id", text="t")


def p_pages(spark, sf):
    return policy_hits(pages(spark, sf), "page_id", text="html", policies=ALL_POLICIES).select("page_id", "policy", "action")


def changes(spark, sf) -> DataFrame:
    """Policy changes made of events: mixed additions (some with a bad pattern
    or action) and removals of user-numbered and default names."""
    n = F.col("event_id")
    names = F.array(*[F.lit(p.name) for p in POLICIES])
    return events(spark, sf).select(
        n.alias("seq"), F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("op"),
        F.when(n % 13 == 0, F.element_at(names, (n % 5 + 1).cast("int")))
        .otherwise(F.concat(F.lit("p"), F.col("user_id").cast("string"))).alias("name"),
        F.element_at(F.array(*[F.lit(p) for p in CHANGE_PATTERNS]), (n % len(CHANGE_PATTERNS) + 1).cast("int")).alias("pattern"),
        F.element_at(F.array(*[F.lit(a) for a in CHANGE_ACTIONS]), (n % len(CHANGE_ACTIONS) + 1).cast("int")).alias("action"),
        F.col("event_type").alias("description"))


def p_upsert(spark, sf):
    return apply_changes(policy_table(spark), changes(spark, sf)).select("ord", "name", "pattern", "action", "description")


def p_remove(spark, sf):
    """A policy per document, less those whose numbers users with errors bear."""
    one_each = table(spark, sf, "documents").select(
        F.col("doc_id").alias("ord"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("name"),
        F.col("lang").alias("pattern"), F.lit("warn").alias("action"), F.col("source").alias("description"))
    later = changes(spark, sf).where("op = 'remove'").withColumn("seq", F.col("seq") + 1_000_000_000)
    return apply_changes(one_each, later).select("ord", "name", "pattern", "action")


def p_versions(spark, sf):
    return policy_versions(policy_table(spark), changes(spark, sf)).select("from_seq", "to_seq", "name", "action")


def p_version_hits(spark, sf):
    """Turn texts of all events against the policy versions in force then, of
    a fixed number of policy names."""
    texts = requests(spark, sf).select("seq", "text")
    few = changes(spark, sf).withColumn("name", F.when(F.col("seq") % 13 == 0, F.col("name")).otherwise(
        F.concat(F.lit("p"), (F.col("seq") % 7).cast("string"))))
    return version_hits(texts, policy_versions(policy_table(spark), few), "seq").select("seq", "policy", "action")


# -- limiter -------------------------------------------------------------------
def r_limiter(spark, sf):
    return limited_events(spark, sf).select("seq", "limited")


def r_retry_after(spark, sf):
    return limited_events(spark, sf).where("limited").select("seq", "user_id", "retry_after")


def r_default_key(spark, sf):
    """Missing users share one key."""
    ev = events(spark, sf).select(F.col("event_id").alias("seq"), "us", _user().alias("user_id"))
    return rate_limit(ev, max_requests=LIMIT, window_us=DAY_US, ts="us").select("seq", "limited", "retry_after")


def r_hot_key(spark, sf):
    """A third of all events under one key, cut into chunks."""
    ev = events(spark, sf).select(F.col("event_id").alias("seq"), "us", F.when(
        F.col("event_id") % 3 != 0, F.col("user_id").cast("string")).alias("user_id"))
    hot_rows = ev.count() // 9 + 1
    return rate_limit(ev, max_requests=20, window_us=DAY_US, ts="us", hot_rows=hot_rows).select(
        "seq", "limited", "retry_after")


def r_tenant(spark, sf):
    ev = events(spark, sf).select(F.col("event_id").alias("seq"), "us", F.col("user_id").cast("string").alias("user_id"),
                                  F.col("event_type").alias("tenant_id"))
    return rate_limit(ev, max_requests=1, window_us=DAY_US, ts="us", tenant="tenant_id").select("seq", "limited", "retry_after")


def r_active_users(spark, sf):
    return active_users(events(spark, sf).select(_user().alias("user_id")))


def r_stream(spark, sf):
    return _run_stream(spark, stream_rate_limit(
        _event_stream(spark, sf).select(F.col("event_id").alias("seq"), "us", F.col("user_id").cast("string").alias("user_id")),
        max_requests=LIMIT, window_us=DAY_US, ts="us")).select("seq", "limited", "retry_after")


def r_stream_batches(spark, sf):
    """The batch limiter run on micro-batches with carried stamps."""
    out = _scratch(spark)
    stream = _event_stream(spark, sf).select(F.col("event_id").alias("seq"), "us", _user().alias("user_id"))
    limit_batches(stream, out + "/limits", out + "/offsets", max_requests=LIMIT, window_us=DAY_US, ts="us").awaitTermination()
    return spark.read.parquet(out + "/limits/data").select("seq", "limited", "retry_after")


def _event_stream(spark, sf) -> DataFrame:
    _tables(spark)
    schema = table(spark, sf, "events").schema
    read = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return read.select("event_id", "ts", "user_id", "event_type", "value", micros(F.col("ts")).alias("us"))


def _run_stream(spark, stream: DataFrame) -> DataFrame:
    """Runs a stream over all its input into a scratch table and reads that."""
    out = _scratch(spark)
    (stream.writeStream.format("parquet").option("path", out + "/data").option("checkpointLocation", out + "/state")
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(out + "/data")


# -- gate ----------------------------------------------------------------------
def g_verdict(spark, sf):
    return verdicts(spark, sf).drop("ts")


def g_codes(spark, sf):
    return verdicts(spark, sf).groupBy(F.coalesce("code", F.lit("ALLOWED")).alias("code"), "allowed").agg(F.count("*").alias("requests"))


def g_detail(spark, sf):
    return detailed(spark, sf).select("seq", "code", "validation.valid", "validation.sanitized",
                    F.size("validation.violations").cast("long").alias("listed_violations"),
                    F.col("policy.allowed").alias("policy_allowed"),
                    F.array_join(F.transform("policy.violations", lambda r: r["policy"]), ",").alias("policy_violations"),
                    F.array_join(F.transform("policy.warnings", lambda r: r["policy"]), ",").alias("policy_warnings"))


def g_switches(spark, sf):
    """Each stage switched off in turn; texts are screened and limits decided
    once for all of them."""
    names = ("enable_rate_limiting", "enable_input_validation", "enable_policy_enforcement")
    screened = screen_requests(requests(spark, sf), GATE, ALL_POLICIES).select(
        "seq", "ts", "user_id", "n_bytes", "input_mask", "policy_masks")
    settings = settings_of(GATE) | {name: F.col("off") != name for name in names}
    rows = (limit_requests(screened, GATE, DAY_US, HOT_ROWS).withColumn("off", F.explode(F.array(*[F.lit(name) for name in names])))
            .withColumn("limited", F.col("limited") & settings["enable_rate_limiting"]))
    return verdict_columns(rows, settings, policy_counts(ALL_POLICIES)).select(
        "off", "seq", "code", "n_violations", "n_policy_violations", "n_warnings")


def g_stream(spark, sf):
    stream = as_requests(_event_stream(spark, sf), spark, sf)
    return _run_stream(spark, stream_gate(stream, GATE, ALL_POLICIES, window_us=DAY_US)).select(
        "seq", "request_id", "user_id", "allowed", "code", "reason", "n_violations", "n_policy_violations", "n_warnings")


# -- audit ---------------------------------------------------------------------
def a_events(spark, sf):
    return _flat_audit(audit_log(spark, sf))


def a_retention(spark, sf):
    return audit.retained(audit_log(spark, sf), KEEP).select("seq", "event_type", "details")


def a_retention_days(spark, sf):
    """The same from a log partitioned by day, of which only the newest days are read."""
    path = _scratch(spark)
    sinks.append_audit(audit_log(spark, sf), path)
    return sinks.newest_events(spark, path, KEEP).select("seq", "event_type", "details")


def a_logs_newest(spark, sf):
    return audit.get_logs(audit_log(spark, sf)).select("seq", "event_type", "details", "user_id")


def a_logs_by_type(spark, sf):
    return audit.get_logs(audit_log(spark, sf), "INPUT_BLOCKED", 20, keep=KEEP).select("seq", "event_type", "details", "user_id")


def a_totals(spark, sf):
    return audit.totals(audit_log(spark, sf))


def a_stats(spark, sf):
    return audit.get_stats(audit_log(spark, sf), requests(spark, sf), GATE)


def _flat_rollup(rolled: DataFrame) -> DataFrame:
    return rolled.select(F.unix_micros("window_start").alias("window_us"), "event_type", "events", "blocked", "rate_limit_hits")


def a_rollup(spark, sf):
    return _flat_rollup(audit.rollup(audit_log(spark, sf), "event_type"))


def a_rollup_users(spark, sf):
    rolled = audit.rollup(audit_log(spark, sf), "user_id", every="7 days")
    return rolled.select(F.unix_micros("window_start").alias("window_us"), "user_id", "events", "blocked", "rate_limit_hits")


def _typed_stream(spark, sf) -> DataFrame:
    return _event_stream(spark, sf).select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", "INPUT_BLOCKED").when(F.col("event_type") == "view", "RATE_LIMIT_EXCEEDED")
        .otherwise("INPUT_PROCESSED").alias("event_type"))


def a_stream(spark, sf):
    """Windowed counts of an audit stream, with the windows that are still open
    when the input ends."""
    out = _scratch(spark)
    write_rollup(stream_rollup(_typed_stream(spark, sf), "event_type"), out + "/data", out + "/state").awaitTermination()
    return _flat_rollup(read_rollup(spark, out + "/data", "event_type"))


# -- configuration and replay --------------------------------------------------
def patches(spark, sf) -> DataFrame:
    n, kind = F.col("event_id"), F.col("event_type")
    return events(spark, sf).select(
        n.alias("seq"), F.when(kind == "error", n % 7 - 1).alias("max_requests_per_minute"),
        F.when(kind == "click", (n % 5) * 100 - 100).alias("max_tokens_per_request"),
        F.when(kind == "view", n % 3 == 0).alias("enable_input_validation"),
        F.when(kind == "signup", n % 2 == 0).alias("enable_output_filtering"),
        F.when((kind == "signup") & (n % 4 < 2), n % 3 == 1).alias("enable_policy_enforcement"),
        F.when(kind == "purchase", n % 4 == 0).alias("enable_rate_limiting"))


def c_history(spark, sf):
    return config_history(patches(spark, sf))


def call_lines(spark, sf) -> DataFrame:
    """A call log as JSON lines made of all events (seq, ts, value): mostly
    input checks, with output filters, policy checks, setting and policy
    changes, blank and broken lines, and wrongly typed arguments between."""
    n = F.col("event_id")
    ev = _with_turn(spread(events(spark, sf)), spark, sf).withColumn(
        "text", with_payload(F.col("turn_text"), n, REQUEST_PAYLOADS))
    pattern = F.element_at(F.array(*[F.lit(p) for p in REPLAY_PATTERNS]), (n % len(REPLAY_PATTERNS) + 1).cast("int"))
    action = F.element_at(F.array(*[F.lit(a) for a in CHANGE_ACTIONS]), (n % len(CHANGE_ACTIONS) + 1).cast("int"))
    name = F.when(n % 3 == 0, "no_path_traversal").otherwise(F.concat(F.lit("p"), (n % 11).cast("string")))

    def line(tool: str, arguments: Column) -> Column:
        return F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), n.alias("id"), F.lit("tools/call").alias("method"),
                                  F.struct(F.lit(tool).alias("name"), arguments.alias("arguments")).alias("params")))

    value = (
        F.when(n % 101 == 1, "").when(n % 101 == 2, "not json").when(n % 101 == 3, '{"jsonrpc": 2, "method": "tools/call"}')
        .when(n % 101 == 4, '{"jsonrpc": "2.0", "method": "tools/list"}')
        .when(n % 101 == 5, line("unknown_tool", F.struct("text")))
        .when(n % 97 == 0, line("update_config", F.struct(
            F.when(n % 2 == 0, n % 5).alias("max_requests_per_minute"), F.when(n % 5 == 1, n % 90).alias("max_tokens_per_request"),
            F.when(n % 7 == 2, n % 4 != 0).alias("enable_rate_limiting"), F.lit("no").alias("enable_input_validation"),
            F.when(n % 5 == 4, n % 3 != 0).alias("enable_policy_enforcement"),
            F.when(n % 5 == 3, n % 2 == 0).alias("enable_output_filtering"))))
        .when(n % 89 == 0, line("add_policy", F.struct(name.alias("name"), pattern.alias("pattern"), action.alias("action"))))
        .when(n % 83 == 0, line("remove_policy", F.struct(name.alias("name"))))
        .when(n % 10 == 3, line("filter_output", F.struct("text")))
        .when(n % 10 == 4, line("check_policy", F.struct("text", F.when(n % 20 == 4, F.array(
            F.lit("no_xxe"), F.lit("no_command_injection"), F.lit("p4"))).alias("policy_names"))))
        .when(n % 10 == 5, line("validate_input", F.struct(n.alias("text"), F.col("user_id"))))
        .otherwise(line("validate_input", F.struct("text", F.col("user_id").cast("string").alias("user_id")))))
    return ev.select(n.alias("seq"), F.col("ts").cast("timestamp").alias("ts"), value.alias("value"))


def asked_lines(spark, sf) -> DataFrame:
    """The same log with questions between its calls: get_stats after every
    ninth event and get_audit_logs, with types and limits of all kinds, after
    another ninth.  Calls have even numbers, questions the odd one after."""
    n = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(t) for t in ASKED_TYPES]), (n % len(ASKED_TYPES) + 1).cast("int"))
    limit = F.when(n % 11 == 0, '"x"').when(n % 11 < 9, (n % 7 * 10).cast("string"))

    def line(tool: str, arguments: Column) -> Column:
        return F.concat(F.lit(f'{{"jsonrpc":"2.0","method":"tools/call","params":{{"name":"{tool}","arguments":{{'), arguments, F.lit("}}}"))

    logs = F.concat_ws(",", F.concat(F.lit('"event_type":"'), kind, F.lit('"')), F.concat(F.lit('"limit":'), limit))
    asks = events(spark, sf).where(n % 9 % 3 == 1).where(n % 9 < 5).select(
        (2 * n + 1).alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(n % 9 == 1, line("get_stats", F.lit(""))).otherwise(line("get_audit_logs", logs)).alias("value"))
    return call_lines(spark, sf).withColumn("seq", 2 * F.col("seq")).unionByName(asks)


def calls(spark, sf) -> DataFrame:
    return tool_calls(parse_calls(call_lines(spark, sf)))


def s_call_log(spark, sf):
    return calls(spark, sf).select(
        "seq", "tool", "known", "text", "user_id", F.array_join("policy_names", ",").alias("policy_names"), "limit",
        "name", "pattern", "action", "max_requests_per_minute", "enable_rate_limiting", "enable_input_validation")


def _replay(spark, sf) -> Replay:
    return replay(calls(spark, sf), window_us=REPLAY_WINDOW_US)


def c_replay(spark, sf):
    return _replayed(_replay(spark, sf).verdicts)


def _replayed(verdicts: DataFrame) -> DataFrame:
    return verdicts.select(
        "seq", "user_id", "allowed", "code", "reason", "n_violations", "n_policy_violations", "n_warnings",
        F.array_join(F.transform("policy_hits", lambda r: r["policy"]), ",").alias("policies"))


def c_replay_stream(spark, sf):
    """The same log arriving in three parts, each replayed from what the last one left."""
    out, lines, files = _scratch(spark), call_lines(spark, sf), 8
    third, two = lines.select(F.percentile_approx("seq", [1 / 3, 2 / 3])).first()[0]
    for part in (lines.where(F.col("seq") <= third), lines.where((F.col("seq") > third) & (F.col("seq") <= two)), lines.where(F.col("seq") > two)):
        part.repartition(files).write.mode("append").parquet(out + "/lines")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", files).parquet(out + "/lines")
    replay_batches(stream, out + "/run", out + "/offsets", window_us=REPLAY_WINDOW_US).awaitTermination()
    return _replayed(spark.read.parquet(out + "/run/verdicts"))


def c_replay_checks(spark, sf):
    return _replay(spark, sf).checks.select(
        "seq", "allowed", "n_policy_violations", "n_warnings",
        F.array_join(F.transform("policy_hits", lambda r: r["policy"]), ",").alias("policies"))


def c_replay_outputs(spark, sf):
    return _replay(spark, sf).outputs.select("seq", "modified", "redacted", F.size("redactions").cast("long").alias("n_redactions"))


def c_replay_audit(spark, sf):
    return _replay(spark, sf).audit.select("seq", "event_type", "details", "user_id")


def _asked(spark, sf) -> Replay:
    return replay(tool_calls(parse_calls(asked_lines(spark, sf))), window_us=REPLAY_WINDOW_US, keep=KEEP)


def c_replay_stats(spark, sf):
    """The answer of every get_stats call in the log."""
    return _asked(spark, sf).stats


def c_replay_logs(spark, sf):
    """The answer of every get_audit_logs call in the log, a row per event."""
    return _asked(spark, sf).logs.select("ask", "position", "seq", "event_type", "details", "user_id")


# -- sinks ---------------------------------------------------------------------
def s_audit_sink(spark, sf):
    path = _scratch(spark)
    sinks.append_audit(audit_log(spark, sf), path)
    return _flat_audit(sinks.read_audit(spark, path))


def s_rejected_lines(spark, sf):
    """Unusable lines of the call log and why."""
    return rejected_lines(call_lines(spark, sf)).select("seq", "reason")


def s_verdict_json(spark, sf):
    return detailed(spark, sf).select("seq", sinks.verdict_json().alias("verdict"))


def d_handler(spark, sf):
    """An event stream written to a log, and its blocked events to a second
    table by a handler, both read as far as they are committed."""
    out = _scratch(spark)
    alerts = second_table(out + "/alerts", lambda batch: batch.where(audit.is_blocked(F.col("event_type"))))
    write_with_handler(_typed_stream(spark, sf), out + "/log", alerts, out + "/offsets").awaitTermination()
    log, second = read_committed(spark, out + "/log"), read_committed(spark, out + "/alerts", out + "/log")
    return (log.select(F.lit("log").alias("sink"), "seq", "event_type")
            .unionByName(second.select(F.lit("alerts").alias("sink"), "seq", "event_type")))


# -- access rules and other documented extras ----------------------------------
def d_user_time(spark, sf):
    log = audit_log(spark, sf)
    return audit.get_logs(log, None, 30, user_id="anonymous", start="2024-01-10", end="2024-01-25",
                          keep=None).select("seq", "event_type", "details")


def d_block_rate(spark, sf):
    rolled = audit.rollup(audit_log(spark, sf))
    return rolled.select(F.unix_micros("window_start").alias("window_us"), "events", "blocked",
                         F.round("block_rate", 6).alias("block_rate"), "rate_limit_hits")


def d_allowlist(spark, sf):
    pages = table(spark, sf, "pages")
    listed = pages.select(access.host_of(F.col("url")).alias("domain")).where(F.col("domain").endswith(".org")).distinct()
    return access.outside_allowlist(pages.select("page_id", "url"), listed)


def d_rbac(spark, sf):
    ev = events(spark, sf).select("event_id", "user_id", F.col("event_type").alias("resource"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role"))
    asked = ev.join(customers, "user_id", "left")       # users without a role are denied
    grants = (table(spark, sf, "customer").select(F.col("c_mktsegment").alias("role")).distinct()
              .withColumn("resource", F.explode(F.array(*[F.lit(x) for x in ("view", "click", "signup")])))
              .where(~((F.col("role") == "BUILDING") & (F.col("resource") == "signup"))))
    return access.denied(asked, grants).select("event_id", "role", "resource")


def d_quota(spark, sf):
    ev = events(spark, sf).select(F.col("event_id").alias("seq"), "us", "user_id")
    quotas = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 4).alias("quota"))
    return access.over_quota(ev, quotas).select("seq", "used", "quota", "over")


def d_maintenance(spark, sf):
    ev = events(spark, sf)
    windows = ev.where("event_type = 'purchase'").select(F.col("us").alias("from_us"), (F.col("us") + 60_000_000).alias("to_us"))
    return access.in_maintenance(ev.select("event_id", "us"), windows)


def d_forbidden_calls(spark, sf):
    pages = table(spark, sf, "pages")
    asked = pages.select("page_id", F.try_parse_url("url", F.lit("PATH")).alias("path"),
                         F.try_parse_url("url", F.lit("PROTOCOL")).alias("tool"),
                         F.when(F.col("page_id") % 2 == 0, "u").alias("user_id"))
    return access.forbidden_calls(asked, dangerous_tools=["ftp"], destructive_tools=["https"],
                                  sensitive_paths=["/en/7", "/en/8"]).select("page_id", "refusal")


def d_custom_policy(spark, sf):
    docs = table(spark, sf, "documents")
    checked = access.custom_policies(docs.select("doc_id", "lang", "source", "n_chars"), [
        ("too_big", "block", "Long text", F.col("n_chars") > 3_000),
        ("not_english", "warn", "Other language", F.col("lang") != "en"),
        ("odd", "redact", "Odd number", F.col("doc_id") % 2 == 1)])
    return checked.select("doc_id", "policy.allowed", F.size("policy.violations").cast("long").alias("n_violations"),
                          F.size("policy.warnings").cast("long").alias("n_warnings"))


#: Own rules and replacement text of d_custom_rules.
OWN_RULES = (Rule("HOUSE", "low", "Many digits", "[0-9]{5}", ()), Rule("HOUSE", "low", "Shouting", "[A-Z]{6}", ()))
OWN_TOKEN = "<$1 {}>"


def d_custom_rules(spark, sf):
    """Own rules decide validity and are replaced by an own text."""
    v = detect.validate(planted(spark, sf).select("doc_id", "t"), "t", SHORT_TOKENS, OWN_RULES, OWN_RULES, OWN_TOKEN)
    return v.select("doc_id", "validation.valid", "validation.sanitized", F.size("validation.violations").cast("long").alias("n_violations"))


def d_rotation(spark, sf):
    """The audit table after log rotation: whole days before one are dropped."""
    name = f"audit_{uuid.uuid4().hex}"
    sinks.audit_table(audit_log(spark, sf), name)
    sinks.drop_days_before(spark, name, ROTATE_BEFORE)
    return _flat_audit(spark.table(name))


QUERIES: dict[str, Query] = {
    "v_length": v_length,
    "v_injection_hits": _hit_rows("INJECTION"),
    "v_code_hits": _hit_rows("MALICIOUS_CODE"),
    "v_pii_hits": _hit_rows("PII"),
    "v_rule_report": v_rule_report,
    "v_pages_report": v_pages_report,
    "v_validate_summary": v_validate_summary,
    "v_violation_list": v_violation_list,
    "v_validate": v_validate,
    "v_sanitize": v_sanitize,
    "f_secret_redact": f_secret_redact,
    "f_pii_redact": f_pii_redact,
    "f_redact_text": f_redact_text,
    "f_redaction_list": f_redaction_list,
    "f_report": f_report,
    "f_report_natural": f_report_natural,
    "f_report_quality": f_report_quality,
    "f_outputs": f_outputs,
    "f_disabled": f_disabled,
    "f_extra_kinds": f_extra_kinds,
    "p_evaluate": p_evaluate,
    "p_routing": p_routing,
    "p_subset": p_subset,
    "p_hits": p_hits,
    "p_rule_join": p_rule_join,
    "p_pages": p_pages,
    "p_upsert": p_upsert,
    "p_remove": p_remove,
    "p_versions": p_versions,
    "p_version_hits": p_version_hits,
    "r_limiter": r_limiter,
    "r_retry_after": r_retry_after,
    "r_default_key": r_default_key,
    "r_hot_key": r_hot_key,
    "r_tenant": r_tenant,
    "r_active_users": r_active_users,
    "r_stream": r_stream,
    "r_stream_batches": r_stream_batches,
    "g_verdict": g_verdict,
    "g_codes": g_codes,
    "g_detail": g_detail,
    "g_switches": g_switches,
    "g_stream": g_stream,
    "a_events": a_events,
    "a_retention": a_retention,
    "a_retention_days": a_retention_days,
    "a_logs_newest": a_logs_newest,
    "a_logs_by_type": a_logs_by_type,
    "a_totals": a_totals,
    "a_stats": a_stats,
    "a_rollup": a_rollup,
    "a_rollup_users": a_rollup_users,
    "a_stream": a_stream,
    "c_history": c_history,
    "c_replay": c_replay,
    "c_replay_stream": c_replay_stream,
    "c_replay_checks": c_replay_checks,
    "c_replay_outputs": c_replay_outputs,
    "c_replay_audit": c_replay_audit,
    "c_replay_stats": c_replay_stats,
    "c_replay_logs": c_replay_logs,
    "s_call_log": s_call_log,
    "s_audit_sink": s_audit_sink,
    "s_verdict_json": s_verdict_json,
    "s_rejected_lines": s_rejected_lines,
    "d_user_time": d_user_time,
    "d_block_rate": d_block_rate,
    "d_allowlist": d_allowlist,
    "d_rbac": d_rbac,
    "d_quota": d_quota,
    "d_maintenance": d_maintenance,
    "d_forbidden_calls": d_forbidden_calls,
    "d_custom_policy": d_custom_policy,
    "d_custom_rules": d_custom_rules,
    "d_rotation": d_rotation,
    "d_handler": d_handler,
}
