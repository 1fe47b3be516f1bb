"""Policy evaluation as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from .matching import case_folded, computed_once, hits
from .rules import POLICIES, Policy

RECORD = "struct<policy:string,action:string,description:string>"
SLICE = 60      # policies per mask


def _slices(policies: Sequence[Policy]) -> list[Sequence[Policy]]:
    return [policies[i:i + SLICE] for i in range(0, len(policies), SLICE)]


def policy_masks(text: Column, policies: Sequence[Policy] = POLICIES, names: Column | None = None) -> Column:
    """``array<bigint>``: one bit per policy that fires, 60 policies to a mask.

    *names* (``array<string>`` per row) restricts the policies looked at: null
    means all, an empty array none; unknown names are ignored.  The name is
    tested before the text.
    """
    folded = case_folded(text)

    def fires(at: int) -> Column:
        hit = hits(policies[at], text, folded)
        if names is not None:
            hit = (names.isNull() | F.array_contains(names, policies[at].name)) & hit
        return hit

    masks = [
        reduce(lambda a, b: a.bitwiseOR(b),
               [F.when(fires(k * SLICE + i), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
                for i in range(len(part))])
        for k, part in enumerate(_slices(policies))
    ]
    # not one array(): the optimizer copies array constructors into every use,
    # and each copy would run the patterns again
    return F.concat(F.array().cast("array<bigint>"), *[F.array(m) for m in masks])


def hit_places(masks: Column, n: int) -> Column:
    """The places (from 0) of the policies that fired, of *n*, as ``array<int>``."""
    if not n:
        return F.array().cast("array<int>")
    return F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: masks[F.floor(i / SLICE).cast("int")].bitwiseAND(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(i, F.lit(SLICE)))) != 0)


def policy_records(masks: Column, policies: Sequence[Policy] = POLICIES) -> Column:
    """The fired policies in policy order as ``array<struct<policy,action,description>>``."""
    def fired(k: int, part: Sequence[Policy]) -> Column:
        mask = masks[k]
        known = F.array(*[
            F.struct(F.lit(1 << i).cast("long").alias("bit"), F.lit(p.name).alias("policy"),
                     F.lit(p.action).alias("action"), F.lit(p.description).alias("description"))
            for i, p in enumerate(part)
        ])
        return F.transform(
            F.filter(known, lambda v: mask.bitwiseAND(v["bit"]) != 0),
            lambda v: F.struct(v["policy"].alias("policy"), v["action"].alias("action"),
                               v["description"].alias("description")))

    empty = F.array().cast(f"array<{RECORD}>")
    return F.concat(empty, *[F.when(masks[k] != 0, fired(k, part)).otherwise(empty)
                             for k, part in enumerate(_slices(policies))])


def count_by_action(masks: Column, policies: Sequence[Policy], actions: Sequence[str]) -> Column:
    """How many policies with one of *actions* fired."""
    counts = []
    for k, part in enumerate(_slices(policies)):
        bits = sum(1 << i for i, p in enumerate(part) if p.action in actions)
        if bits:
            counts.append(F.bit_count(masks[k].bitwiseAND(F.lit(bits).cast("long"))).cast("long"))
    return reduce(add, counts) if counts else F.lit(0).cast("long")


def violation_count(masks: Column, policies: Sequence[Policy] = POLICIES) -> Column:
    """Block and redact hits; warnings are not violations."""
    return count_by_action(masks, policies, ("block", "redact"))


def warning_count(masks: Column, policies: Sequence[Policy] = POLICIES) -> Column:
    return count_by_action(masks, policies, ("warn",))


def is_allowed(masks: Column, policies: Sequence[Policy] = POLICIES) -> Column:
    """Only a block hit forbids; redact is recorded but allowed."""
    return count_by_action(masks, policies, ("block",)) == 0


def policy_result(masks: Column, policies: Sequence[Policy] = POLICIES) -> Column:
    """``struct<allowed, violations, warnings>``."""
    records = policy_records(masks, policies)
    return F.struct(
        is_allowed(masks, policies).alias("allowed"),
        F.filter(records, lambda r: r["action"] != "warn").alias("violations"),
        F.filter(records, lambda r: r["action"] == "warn").alias("warnings"),
    )


def check_policy(df: DataFrame, text: str = "text", policies: Sequence[Policy] = POLICIES,
                 names: Column | None = None) -> DataFrame:
    """Stand-alone policy check: adds ``policy`` (allowed, violations,
    warnings) to any table, whatever the gate's settings are."""
    return (computed_once(df, "_masks", policy_masks(F.col(text), policies, names))
            .withColumn("policy", policy_result(F.col("_masks"), policies)).drop("_masks"))
