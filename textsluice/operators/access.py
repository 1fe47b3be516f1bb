"""Access rules as joins: allowlists, grants, quotas, maintenance windows,
path and tool lists, and caller-supplied conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import Rule
from .intervals import interval_join, running_total

# Opt-in kinds for redact(personal=...): own patterns, off by default.
EXTRA_OUTPUT_RULES = (
    Rule("PASSWORD", "", "", r"(?i)\b(?:password|passwd|pwd)\s*[=:]\s*\S+", (("password", "passwd", "pwd"),)),
    Rule("CONNECTION_STRING", "", "", r"(?i)\b[a-z][a-z0-9+.\x2d]*://[^\s:/@]+:[^\s@]+@\S+", ("://", "@")),
    Rule("IP_ADDRESS", "", "", r"\b(?:\d{1,3}[.]){3}\d{1,3}\b", (".",), r"\d"),
)


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def outside_allowlist(df: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose host is not a listed bare domain; an unparsable address is
    outside.  *domains* has a ``domain`` column."""
    return df.withColumn("host", host_of(F.col(url))).join(
        domains.select(F.lower("domain").alias("host")), "host", "left_anti").select(*df.columns, host_of(F.col(url)).alias("host"))


def denied(requests: DataFrame, grants: DataFrame, on: Sequence[str] = ("role", "resource")) -> DataFrame:
    """Requests without a matching grant."""
    return requests.join(grants, list(on), "left_anti").select(*requests.columns)


def over_quota(requests: DataFrame, quotas: DataFrame, *, user: str = "user_id", us: str = "us",
               seq: str = "seq", slot_us: int = 60_000_000) -> DataFrame:
    """Adds ``used`` (requests of the user so far that day), ``quota`` and
    ``over``.  Users without a quota row are unlimited."""
    day = requests.withColumn("_day", F.expr(f"{us} div 86400000000"))
    counted = running_total(day, [user, "_day"], us, seq, slot_us=slot_us, name="used")
    return (counted.join(quotas.select(user, "quota"), user, "left")
            .withColumn("over", F.coalesce(F.col("used") > F.col("quota"), F.lit(False)))
            .select(*requests.columns, "used", "quota", "over"))


def in_maintenance(requests: DataFrame, windows: DataFrame, at: str = "us") -> DataFrame:
    """Requests inside a window (``from_us`` inclusive, ``to_us`` exclusive)."""
    return interval_join(requests, at, windows, start="from_us", stop="to_us", how="left_semi")


def forbidden_calls(requests: DataFrame, *, tool: str = "tool", path: str = "path", user: str = "user_id",
                    dangerous_tools: Sequence[str] = (), destructive_tools: Sequence[str] = (),
                    sensitive_paths: Sequence[str] = ()) -> DataFrame:
    """Adds ``refusal``: dangerous_tool, unauthenticated, sensitive_path or
    null.  Paths are prefixes; the anonymous user is unauthenticated."""
    guarded = F.lit(False)
    for prefix in sensitive_paths:
        guarded = guarded | F.startswith(F.col(path), F.lit(prefix))
    nobody = F.coalesce(F.col(user).cast("string"), F.lit("anonymous")) == "anonymous"
    return requests.withColumn(
        "refusal",
        F.when(F.col(tool).isin(*dangerous_tools), "dangerous_tool")
        .when(F.col(tool).isin(*destructive_tools) & nobody, "unauthenticated")
        .when(guarded, "sensitive_path"))


def custom_policies(df: DataFrame, conditions: Sequence[tuple[str, str, str, Column]]) -> DataFrame:
    """Policies given as conditions on any columns: (name, action, description,
    boolean column).  Adds ``policy`` (allowed, violations, warnings) by the
    same routing as pattern policies."""
    record = "array<struct<policy:string,action:string,description:string>>"
    empty = F.array().cast(record)

    def fired(kinds) -> Column:
        return F.concat(empty, *[
            F.when(cond, F.array(F.struct(F.lit(name).alias("policy"), F.lit(action).alias("action"),
                                          F.lit(text).alias("description")))).otherwise(empty)
            for name, action, text, cond in conditions if action in kinds])

    blocked = F.lit(False)
    for _, action, _, cond in conditions:
        if action == "block":
            blocked = blocked | F.coalesce(cond, F.lit(False))
    return df.withColumn("policy", F.struct(
        (~blocked).alias("allowed"), fired(("block", "redact")).alias("violations"), fired(("warn",)).alias("warnings")))
