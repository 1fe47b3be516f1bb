"""Audit events, the newest-first log, and statistics."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import AUDIT_PAGE, AUDIT_RETENTION, SYSTEM_USER
from ..session import ensure_checkpoint_dir
from .config import Config
from .intervals import running_sums
from .limiter import active_users

BLOCKED_PARTS = ("BLOCKED", "VIOLATION", "RATE_LIMIT")      # fixed values
COLUMNS = ["seq", "id", "event_type", "ts", "details", "user_id"]
#: Ranks that share a key when answers are looked up; an answer reads whole ones.
RANKS = 64


def event_id(seq: Column, kind: str) -> Column:
    """Repeatable ids: requests and audit entries of one seq differ."""
    return F.concat(F.lit("gr_"), F.md5(F.concat(F.lit(kind + ":"), seq.cast("string"))))


def is_blocked(event_type: Column) -> Column:
    """Case-sensitive: the type contains one of the blocking words."""
    first, *others = [F.contains(event_type, F.lit(p)) for p in BLOCKED_PARTS]
    for other in others:
        first = first | other
    return first


def verdict_event(code: Column) -> Column:
    """The type of event that a verdict of this code logs."""
    return (F.when(code == "RATE_LIMIT", "RATE_LIMIT_EXCEEDED").when(code == "VALIDATION_ERROR", "INPUT_BLOCKED")
            .when(code == "POLICY_VIOLATION", "POLICY_VIOLATION").otherwise("INPUT_PROCESSED"))


def events_of_verdicts(verdicts: DataFrame) -> DataFrame:
    """One audit event per gate call."""
    code = F.col("code")
    found = F.concat(F.when(code == "VALIDATION_ERROR", F.col("n_violations"))
                     .otherwise(F.col("n_policy_violations")).cast("string"), F.lit(" violations"))
    return verdicts.select(
        "seq", event_id(F.col("seq"), "audit").alias("id"),
        verdict_event(code).alias("event_type"), "ts",
        F.when(code == "RATE_LIMIT", F.concat(F.lit("retry_after="), F.col("retry_after").cast("string"), F.lit("s")))
        .when(code.isNotNull(), found).otherwise("ok").alias("details"),
        "user_id")


def events_of_outputs(outputs: DataFrame) -> DataFrame:
    """One audit event per filtered output; *outputs* has seq, ts, redactions.
    Outputs passed through while filtering is off (null list) log nothing."""
    return outputs.where(F.col("redactions").isNotNull()).select(
        "seq", event_id(F.col("seq"), "audit").alias("id"), F.lit("OUTPUT_FILTERED").alias("event_type"), "ts",
        F.concat(F.size("redactions").cast("string"), F.lit(" redactions")).alias("details"),
        F.lit(SYSTEM_USER).alias("user_id"))


def retained(audit: DataFrame, keep: int = AUDIT_RETENTION) -> DataFrame:
    """The newest entries by seq: a top-k, each task keeping at most *keep* rows."""
    return audit.orderBy(F.desc("seq")).limit(keep)


def page_size(limit) -> int:
    """Whole non-negative numbers count; anything else is the default page."""
    usable = isinstance(limit, int) and not isinstance(limit, bool) and limit >= 0
    return limit if usable else AUDIT_PAGE


def get_logs(audit: DataFrame, event_type: str | None = None, limit=AUDIT_PAGE, *, user_id: str | None = None,
             start=None, end=None, keep: int | None = AUDIT_RETENTION) -> DataFrame:
    """Newest first; filters apply to the retained entries (``keep=None``: to
    the whole log), the limit after them.  User and time filters (start
    inclusive, end exclusive) are extras."""
    logs = audit if keep is None else retained(audit, keep)
    if event_type is not None:
        logs = logs.where(F.col("event_type") == event_type)
    if user_id is not None:
        logs = logs.where(F.col("user_id") == user_id)
    if start is not None:
        logs = logs.where(F.col("ts") >= F.lit(start))
    if end is not None:
        logs = logs.where(F.col("ts") < F.lit(end))
    return logs.orderBy(F.desc("seq")).limit(page_size(limit))


def totals(audit: DataFrame) -> DataFrame:
    """All events ever logged, and the blocked ones, in one pass."""
    return audit.agg(F.count("*").alias("total_requests"),
                     F.count_if(is_blocked(F.col("event_type"))).alias("blocked_requests"))


def get_stats(audit: DataFrame, requests: DataFrame, config: Config = Config()) -> DataFrame:
    """One row: users the limiter has seen, event counters over the whole log
    (not cut by retention), and the settings in force."""
    users = active_users(requests if config.enable_rate_limiting else requests.limit(0))    # only the limiter sees users
    both = (
        totals(audit).withColumn("active_users", F.lit(0).cast("long"))
        .unionByName(users.withColumn("total_requests", F.lit(0).cast("long"))
                     .withColumn("blocked_requests", F.lit(0).cast("long")))
        .agg(*[F.sum(c).alias(c) for c in ("active_users", "total_requests", "blocked_requests")])
    )
    return both.select("*", *[F.lit(v).alias(k) for k, v in asdict(config).items()])


def counters_as_of(log: DataFrame, first_seen: DataFrame, asks: DataFrame) -> DataFrame:
    """(seq, active_users, total_requests, blocked_requests) at every row of
    *asks* (seq): the log's events (seq, event_type) and the users (seq of their
    first request to the limiter) before it.

    A user counts once, where first seen, so distinct users are a running sum
    like the other two.
    """
    names = ("active_users", "total_requests", "blocked_requests")
    ensure_checkpoint_dir(log.sparkSession)

    def marks(df: DataFrame, *values, ask: bool = False) -> DataFrame:
        return df.select("seq", *[F.lit(v).cast("long").alias(c) for c, v in zip(names, values)], F.lit(ask).alias("_ask"))

    rows = (marks(log, 0, 1, is_blocked(F.col("event_type"))).unionByName(marks(first_seen, 1, 0, 0))
            .unionByName(marks(asks, 0, 0, 0, ask=True)).checkpoint())
    return running_sums(rows, "seq", names).where("_ask").drop("_ask")


def logs_as_of(log: DataFrame, asks: DataFrame, *, keep: int = AUDIT_RETENTION) -> DataFrame:
    """The answers of ``get_logs`` at many points of an ordered log: rows (ask,
    position, seq, id, event_type, ts, details, user_id), newest first from
    position 0, for every row of *asks* (seq, event_type or null, limit).

    An event's rank is its place in the whole log and among events of its type.
    An ask wants a range of ranks below its own place, none that retention had
    dropped by then; ranges meet events on stretches of ``RANKS`` ranks.  The
    work grows with the log and with the answers, which have at most *keep*
    rows each.
    """
    ensure_checkpoint_dir(log.sparkSession)
    key = F.coalesce(F.concat(F.lit("="), "event_type"), F.lit("*"))        # an ask without a type reads all
    none = F.lit(None)
    events = log.select(*COLUMNS, F.lit(1).alias("_all"), F.lit(1).alias("_own"), key.alias("_key"), none.cast("long").alias("_limit"))
    wanted = asks.select(
        "seq", none.cast("string").alias("id"), "event_type", none.cast("timestamp").alias("ts"), none.cast("string").alias("details"),
        none.cast("string").alias("user_id"), F.lit(0).alias("_all"), F.lit(0).alias("_own"), key.alias("_key"),
        F.least(F.col("limit").cast("long"), F.lit(keep)).alias("_limit"))
    rows = running_sums(events.unionByName(wanted).checkpoint(), "seq", ["_all"]).checkpoint()
    rows = running_sums(rows, "seq", ["_own"], keys=["_key"]).checkpoint()
    upto = F.when(F.col("_key") == "*", F.col("_all")).otherwise(F.col("_own"))
    ranges = (rows.where(F.col("_limit").isNotNull()).select(F.col("seq").alias("ask"), "_key", upto.alias("_upto"), (F.col("_all") - keep).alias("_gone"),
                                                              F.greatest(upto - F.col("_limit"), F.lit(0)).alias("_above"))
              .where("_upto > _above"))
    placed = rows.where(F.col("_limit").isNull()).select(*COLUMNS, "_all", F.explode(F.array(
        F.struct(F.lit("*").alias("k"), F.col("_all").alias("rank")), F.struct(F.col("_key").alias("k"), F.col("_own").alias("rank")))).alias("_at")).select(
        *COLUMNS, "_all", F.col("_at.k").alias("_key"), F.col("_at.rank").alias("_rank"), F.expr(f"_at.rank div {RANKS}").alias("_stretch"))
    looked = ranges.withColumn("_stretch", F.explode(F.expr(f"sequence((_above + 1) div {RANKS}, _upto div {RANKS})")))
    held = (F.col("_rank") > F.col("_above")) & (F.col("_rank") <= F.col("_upto")) & (F.col("_all") > F.col("_gone"))
    return looked.join(placed, ["_key", "_stretch"]).where(held).select("ask", (F.col("_upto") - F.col("_rank")).alias("position"), *COLUMNS)


def rollup(audit: DataFrame, *by: str, every: str = "1 day", ts: str = "ts") -> DataFrame:
    """Events, blocked and rate-limited counts and block rate per time window
    and *by* columns.  Also works on a stream with a watermark on *ts*."""
    blocked, limited = is_blocked(F.col("event_type")), F.col("event_type") == "RATE_LIMIT_EXCEEDED"
    return (
        audit.groupBy(F.window(ts, every), *by)
        .agg(F.count("*").alias("events"), F.count_if(blocked).alias("blocked"),
             F.count_if(limited).alias("rate_limit_hits"))
        .withColumn("block_rate", F.col("blocked") / F.col("events"))
        .withColumn("window_start", F.col("window.start")).drop("window")
    )
