"""Column helpers shared by detection, redaction and policies."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from .dialect import to_java


def case_folded(text: Column) -> Column:
    """Lower-cased text in which every character that folds to an ASCII letter
    is that letter (``lower`` already maps the Kelvin sign; long s it keeps)."""
    return F.replace(F.lower(text), F.lit("\u017f"), F.lit("s"))


def may_hit(rule, text: Column, folded: Column) -> Column | None:
    """Byte-level substring test that every matching text passes."""
    where = folded if rule.ignores_case else text
    tests = [
        reduce(or_, [F.contains(where, F.lit(n)) for n in ((need,) if isinstance(need, str) else need)])
        for need in rule.needs
    ]
    return reduce(and_, tests) if tests else None


def hits(rule, text: Column, folded: Column) -> Column:
    """True where the pattern occurs anywhere in the text."""
    test = text.rlike(to_java(rule.pattern, getattr(rule, "starts", "")))
    guard = may_hit(rule, text, folded)
    return test if guard is None else guard & test


#: Rules that one mask holds.
MASK_RULES = 63


def hit_mask(rules, text: Column, folded: Column) -> Column:
    """One bit per rule (at most ``MASK_RULES``): the only thing later steps need to
    know about a text, so shuffles downstream carry eight bytes for it."""
    if len(rules) > MASK_RULES:
        raise ValueError(f"a mask holds at most {MASK_RULES} rules; build one per slice of the rules")
    bits = [F.when(hits(r, text, folded), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
            for i, r in enumerate(rules)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits) if bits else F.lit(0).cast("long")


#: What a match becomes; the braces stand for the rule's category.
TOKEN = "[REDACTED_{}]"


def replace_in_turn(rules, text: Column, token: str = TOKEN) -> Column:
    """Every rule's matches replaced by its token, each rule working on the
    result of the one before."""
    for rule in rules:
        plain = token.replace("{}", rule.category).replace("\\", "\\\\").replace("$", "\\$")
        text = F.regexp_replace(text, F.lit(to_java(rule.pattern, rule.starts)), F.lit(plain))
    return text


def exploded(df: DataFrame, keep: list, items: Column, item: str, position: str | None = None) -> DataFrame:
    """One row per array item.  As an outer explode with the empty rows taken
    out after it: for an inner one the optimizer adds a "has items" filter and
    copies it, patterns and all, below the projection that computes the items."""
    rows = df.select(*keep, F.posexplode_outer(items).alias("_at", item)).where(F.col("_at").isNotNull())
    if position is None:
        return rows.drop("_at")
    return rows.withColumn(position, F.col("_at").cast("long")).drop("_at")


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds *value* as a column that is computed exactly once per row.

    A plain projection is copied into every filter above it when the optimizer
    pushes the filter down, which for pattern matching multiplies the work.  A
    filter cannot move below a generator it reads from, and other filters still
    can.  The column is computed even if nothing reads it.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))
