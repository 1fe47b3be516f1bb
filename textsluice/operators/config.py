"""Gate settings and their history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.rules import MAX_REQUESTS, MAX_TOKENS
from .intervals import in_blocks, running_last


@dataclass(frozen=True)
class Config:
    enable_input_validation: bool = True
    enable_output_filtering: bool = True
    enable_policy_enforcement: bool = True
    enable_rate_limiting: bool = True
    max_requests_per_minute: int = MAX_REQUESTS
    max_tokens_per_request: int = MAX_TOKENS

    def __post_init__(self):
        if self.max_requests_per_minute < 1 or self.max_tokens_per_request < 0:
            raise ValueError("max_requests_per_minute must be at least 1 and max_tokens_per_request at least 0")


SWITCHES = ["enable_input_validation", "enable_output_filtering",
            "enable_policy_enforcement", "enable_rate_limiting"]
LIMITS = ["max_requests_per_minute", "max_tokens_per_request"]
FIELDS = SWITCHES + LIMITS


def _valid(name: str) -> Column:
    """A patch value counts only if it is usable; others leave the field as is.
    A request limit of 0 is refused (deviation: it has no defined retry time)."""
    value = F.col(name)
    if name in SWITCHES:
        return value.cast("boolean")
    least = 1 if name == "max_requests_per_minute" else 0
    return F.when(value.cast("long") >= least, value.cast("long"))


def config_history(patches: DataFrame, *, seq: str = "seq", defaults: Config = Config(),
                   blocks: int | None = None) -> DataFrame:
    """Patches (nullable setting columns, unique *seq*) to the settings in
    force after each of them."""
    clean = patches.select(seq, *[
        (_valid(f) if f in patches.columns else F.lit(None).cast("boolean" if f in SWITCHES else "long")).alias(f)
        for f in FIELDS])
    filled = running_last(clean, seq, FIELDS, blocks=blocks)
    return filled.select(seq, *[F.coalesce(F.col(f), F.lit(getattr(defaults, f))).alias(f) for f in FIELDS])


def config_intervals(history: DataFrame, *, seq: str = "seq", defaults: Config = Config()) -> DataFrame:
    """History to (from_seq, to_seq, settings), the defaults first with an open
    start; a patch applies to later calls only, so it starts after its seq."""
    steps = next_start(history.withColumn("from_seq", F.col(seq) + 1).drop(seq))
    begin = history.agg((F.min(seq) + 1).alias("to_seq")).select(
        F.lit(None).cast("long").alias("from_seq"), "to_seq",
        *[F.lit(getattr(defaults, f)).cast("boolean" if f in SWITCHES else "long").alias(f) for f in FIELDS])
    return steps.unionByName(begin)


def next_start(df: DataFrame, start: str = "from_seq", stop: str = "to_seq", *, keys: tuple[str, ...] = (),
               blocks: int | None = None) -> DataFrame:
    """Adds *stop*: the next row's *start* among rows of the same *keys*, or
    null on the last one.  Found per block of the axis, and for a block's last
    row from the blocks after it, so one key may hold most of the rows."""
    blocked = in_blocks(df, start, blocks)
    firsts = blocked.groupBy(*keys, "_block").agg(F.min(start).alias("_first"))
    after = W.partitionBy(*keys).orderBy("_block") if keys else W.orderBy("_block")
    following = firsts.select(*keys, "_block", F.lead("_first").over(after).alias("_next"))
    inside = W.partitionBy(*keys, "_block").orderBy(start)
    return (blocked.withColumn(stop, F.lead(start).over(inside)).join(following, [*keys, "_block"], "left")
            .withColumn(stop, F.coalesce(stop, "_next")).select(*df.columns, stop))
