"""The request gate: limiter, then input rules, then policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import detect, policy as pol
from ..functions.rules import ANONYMOUS, POLICIES, WINDOW_US, Policy
from .audit import event_id
from .config import FIELDS, Config
from .limiter import HOT_ROWS, rate_limit

REASONS = {     # fixed values: code -> reason
    "RATE_LIMIT": "Rate limit exceeded, retry after %ds",
    "VALIDATION_ERROR": "Input validation failed",
    "POLICY_VIOLATION": "Policy violation",
}
VERDICT = ["seq", "request_id", "user_id", "ts", "allowed", "code", "reason", "retry_after",
           "n_violations", "n_policy_violations", "n_warnings"]


def with_defaults(requests: DataFrame) -> DataFrame:
    """Missing text is empty, a missing user is anonymous; an empty user id
    stays as it is."""
    return requests.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn(
        "user_id", F.coalesce(F.col("user_id").cast("string"), F.lit(ANONYMOUS)))


def screen_requests(requests: DataFrame, config: Config = Config(),
                    policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """Everything the gate needs from a text in one map-side projection: its
    length and the hit masks of rules and policies, taken from the raw text.
    A stage that is switched off leaves nulls and is not computed."""
    text = F.col("text")
    mask = detect.input_mask(text) if config.enable_input_validation else F.lit(None).cast("bigint")
    masks = pol.policy_masks(text, policies) if config.enable_policy_enforcement else F.lit(None).cast("array<bigint>")
    return (with_defaults(requests).withColumn("n_bytes", detect.byte_length(text))
            .withColumn("input_mask", mask).withColumn("policy_masks", masks))


def settings_of(config: Config | None = None) -> dict[str, Column]:
    """Settings as columns: constants of *config*, or the row's own columns."""
    return {f: F.col(f) if config is None else F.lit(getattr(config, f)) for f in FIELDS}


def policy_counts(policies: Sequence[Policy]) -> dict[str, Column]:
    """Block, other-violation and warning counts of the row's policy masks."""
    masks = F.col("policy_masks")
    return {a: pol.count_by_action(masks, policies, (a,)) for a in ("block", "redact", "warn")}


def verdict_columns(limited: DataFrame, settings: dict[str, Column], counts: dict[str, Column]) -> DataFrame:
    """Adds the verdict to screened requests that carry ``limited`` and
    ``retry_after``.  The first failing stage decides; counts of stages that
    were not reached or are off are null."""
    mask, size, code = F.col("input_mask"), F.col("n_bytes"), F.col("code")
    validates, judges = settings["enable_input_validation"], settings["enable_policy_enforcement"]
    most = settings["max_tokens_per_request"]
    reached = validates & ~F.col("limited")
    judged = judges & (code.isNull() | (code == "POLICY_VIOLATION"))
    return (
        limited.withColumn("code", F.when(F.col("limited"), "RATE_LIMIT")
                           .when(validates & ~detect.is_valid(mask, size, most), "VALIDATION_ERROR")
                           .when(judges & (counts["block"] > 0), "POLICY_VIOLATION"))
        .withColumn("allowed", code.isNull())
        .withColumn("request_id", event_id(F.col("seq"), "request"))
        .withColumn("reason", F.when(
            code == "RATE_LIMIT", F.format_string(REASONS["RATE_LIMIT"], F.col("retry_after")))
            .when(code == "VALIDATION_ERROR", REASONS["VALIDATION_ERROR"])
            .when(code == "POLICY_VIOLATION", REASONS["POLICY_VIOLATION"]))
        .withColumn("n_violations", F.when(reached, detect.violation_count(mask, size, most)))
        .withColumn("n_policy_violations", F.when(judged, counts["block"] + counts["redact"]))
        .withColumn("n_warnings", F.when(judged, counts["warn"]))
    )


def limit_requests(screened: DataFrame, config: Config, window_us: int, hot_rows: int, counted: DataFrame | None = None) -> DataFrame:
    """Every request passes the limiter first, whatever becomes of it later."""
    if not config.enable_rate_limiting:
        return (screened.withColumn("limited", F.lit(False))
                .withColumn("retry_after", F.lit(None).cast("bigint")))
    return rate_limit(screened, max_requests=config.max_requests_per_minute,
                      window_us=window_us, hot_rows=hot_rows, counted=counted)


def gate(requests: DataFrame, config: Config = Config(), policies: Sequence[Policy] = POLICIES, *,
         window_us: int = WINDOW_US, hot_rows: int = HOT_ROWS, keys: DataFrame | None = None) -> DataFrame:
    """Verdicts for requests (seq, ts, user_id, text).

    Texts are screened where they are read and dropped before the limiter's
    shuffle, which moves some 60 bytes per request instead of the text.  *keys*
    (seq, ts, user_id) are the same requests without texts, where that is
    cheaper to read.
    """
    screened = screen_requests(requests, config, policies).select(
        "seq", "ts", "user_id", "n_bytes", "input_mask", "policy_masks")
    limited = limit_requests(screened, config, window_us, hot_rows, keys)
    return verdict_columns(limited, settings_of(config), policy_counts(policies)).select(*VERDICT)


def detailed_gate(requests: DataFrame, config: Config = Config(), policies: Sequence[Policy] = POLICIES, *,
                  window_us: int = WINDOW_US, hot_rows: int = HOT_ROWS, keys: DataFrame | None = None) -> DataFrame:
    """Verdicts with the ``validation`` and ``policy`` structs attached: none
    for a limited request, validation only for an invalid one, else both; a
    stage that is off gives null.

    The limiter decides on (seq, ts, user_id) alone, as in *keys* or *requests*,
    and only the requests it refuses are joined back by seq: where they are few,
    Spark broadcasts them and no text is shuffled.  Texts never pass through
    Python or sit behind a hot user.  With the limiter off nothing is joined.
    """
    screened = screen_requests(requests, config, policies)
    if config.enable_rate_limiting:
        asked = (requests.select("seq", "ts", "user_id") if keys is None else keys).withColumn(
            "user_id", F.coalesce(F.col("user_id").cast("string"), F.lit(ANONYMOUS)))
        refused = limit_requests(asked.select("seq", "ts", "user_id"), config, window_us, hot_rows).where("limited").select("seq", "limited", "retry_after")
        limits = screened.join(refused, "seq", "left").withColumn("limited", F.coalesce("limited", F.lit(False)))
    else:
        limits = limit_requests(screened, config, window_us, hot_rows)
    full = verdict_columns(limits, settings_of(config), policy_counts(policies))
    text, mask, size = F.col("text"), F.col("input_mask"), F.col("n_bytes")
    most = config.max_tokens_per_request
    validation: Column = F.when(F.col("n_violations").isNotNull(), F.struct(
        (F.col("n_violations") == 0).alias("valid"),
        detect.sanitize(text, mask).alias("sanitized"),
        detect.violations(mask, size, most).alias("violations")))
    verdict: Column = F.when(F.col("n_warnings").isNotNull(), pol.policy_result(F.col("policy_masks"), policies))
    return full.withColumn("validation", validation).withColumn("policy", verdict).select(
        *VERDICT, "validation", "policy")
