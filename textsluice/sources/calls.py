"""The call log: newline-delimited JSON calls to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions.matching import computed_once
from ..functions.rules import ANONYMOUS, AUDIT_PAGE
from ..operators.config import LIMITS, SWITCHES

TOOLS = (     # fixed values: the callable tools
    "validate_input", "filter_output", "check_policy", "get_audit_logs",
    "get_stats", "update_config", "add_policy", "remove_policy",
)


def read_lines(spark: SparkSession, path: str, *, stream: bool = False) -> DataFrame:
    """One row per line.  Splittable, so a log of any size is read in parallel."""
    return (spark.readStream if stream else spark.read).text(path)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _at(call: Column, path: str) -> Column:
    return F.try_variant_get(call, path, "variant")


def _string(call: Column, path: str) -> Column:
    """The string at *path*; a value of another type counts as missing."""
    value = _at(call, path)
    return F.when(_kind(value) == "STRING", F.try_variant_get(call, path, "string"))


def _whole(call: Column, path: str) -> Column:
    value = _at(call, path)
    number = F.when(_kind(value) == "BIGINT", F.try_variant_get(call, path, "bigint"))
    return F.when(number >= 0, number)


def _switch(call: Column, path: str) -> Column:
    value = _at(call, path)
    return F.when(_kind(value) == "BOOLEAN", F.try_variant_get(call, path, "boolean"))


def _names(call: Column, path: str) -> Column:
    """A list of strings; a list holding anything else counts as missing."""
    value = _at(call, path)
    kind = _kind(value)
    strings = F.try_variant_get(call, path, "array<string>")
    return (F.when(kind == "ARRAY<VOID>", F.when(F.size(F.try_variant_get(call, path, "array<variant>")) == 0,
                                               F.array().cast("array<string>")))
            .when((kind == "ARRAY<STRING>") & ~F.exists(strings, lambda s: s.isNull()), strings))


def _one_value(text: Column) -> Column:
    """The JSON value a line consists of, or null.  Spark's JSON readers stop
    after the first value, so the line is read as the first of two array items
    whose second, a digest of the line, shows that nothing else was in it."""
    digest = F.md5(text)
    items = F.from_json(F.concat(F.lit("["), text, F.lit(', "'), digest, F.lit('"]')), "array<variant>", {"maxStringLen": str(2**31 - 1)})
    last = F.try_variant_get(items[1], "$", "string")
    return F.when((F.size(items) == 2) & (last == digest), items[0])


#: Why a line is unusable: not UTF-8, not one JSON value, or without string
#: ``jsonrpc`` and ``method``.
REASONS = ("encoding", "json", "shape")


def _judged(lines: DataFrame, value: str) -> DataFrame:
    """Lines that are not blank with ``call``, ``method`` and ``reason``, which
    is null for a call."""
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text, call = F.col(value), F.col("call")
    clear = F.is_valid_utf8(text)
    filled = lines.where(F.trim(text) != "")
    return (
        computed_once(filled, "call", F.when(clear, _one_value(text)))
        .withColumn("method", _string(call, "$.method"))
        .withColumn("reason", F.when(~clear, REASONS[0]).when(call.isNull(), REASONS[1])
                    .when(_string(call, "$.jsonrpc").isNull() | F.col("method").isNull(), REASONS[2]))
    )


def parse_calls(lines: DataFrame, value: str = "value", observation: Observation | None = None) -> DataFrame:
    """Keeps the other columns of *lines* (such as seq and ts) and adds
    ``method`` and the variant ``call``.  Blank lines are skipped and unusable
    ones (see ``REASONS``) dropped; an *observation* gets the number of usable
    lines (``calls``) and of those dropped per reason, on the way.  Of a repeated
    key the last value counts; a text may have any length."""
    judged, reason = _judged(lines, value), F.col("reason")
    if observation is not None:
        judged = judged.observe(observation, F.count_if(reason.isNull()).alias("calls"), *[F.count_if(reason == r).alias(r) for r in REASONS])
    return judged.where(reason.isNull()).drop(value, "reason")


def rejected_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """The unusable lines with all columns of *lines* and the ``reason``; a side
    table to warn by.  Bytes that are not UTF-8 stay as they are."""
    return _judged(lines, value).where(F.col("reason").isNotNull()).select(*lines.columns, "reason")


def tool_calls(parsed: DataFrame) -> DataFrame:
    """Tool calls with every argument typed and defaulted.  ``known`` is false
    for tool names that do nothing."""
    call = F.col("call")
    arg = "$.params.arguments."
    tool = F.coalesce(_string(call, "$.params.name"), F.lit(""))
    keep = [c for c in parsed.columns if c not in ("call", "method")]
    return parsed.where(F.col("method") == "tools/call").select(
        *keep, tool.alias("tool"), tool.isin(*TOOLS).alias("known"),
        F.coalesce(_string(call, arg + "text"), F.lit("")).alias("text"),
        F.coalesce(_string(call, arg + "user_id"), F.lit(ANONYMOUS)).alias("user_id"),
        _names(call, arg + "policy_names").alias("policy_names"),
        _string(call, arg + "event_type").alias("event_type"),
        F.coalesce(_whole(call, arg + "limit"), F.lit(AUDIT_PAGE).cast("long")).alias("limit"),
        F.coalesce(_string(call, arg + "name"), F.lit("")).alias("name"),
        F.coalesce(_string(call, arg + "pattern"), F.lit("")).alias("pattern"),
        F.coalesce(_string(call, arg + "action"), F.lit("block")).alias("action"),
        F.coalesce(_string(call, arg + "description"), F.lit("")).alias("description"),
        *[_whole(call, arg + f).alias(f) for f in LIMITS],
        *[_switch(call, arg + f).alias(f) for f in SWITCHES])
