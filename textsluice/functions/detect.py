"""Input screening: which fixed rules fire, and the text without personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .matching import MASK_RULES, TOKEN, case_folded, computed_once, hit_mask, replace_in_turn
from .policy import SLICE, policy_masks
from .rules import BYTES_PER_TOKEN, INPUT_RULES, MAX_TOKENS, SANITIZE_RULES, Rule

PII_BITS = sum(1 << i for i, r in enumerate(INPUT_RULES) if r.category == "PII")
CATEGORY_BITS = {
    c: sum(1 << i for i, r in enumerate(INPUT_RULES) if r.category == c)
    for c in ("INJECTION", "MALICIOUS_CODE", "PII")
}
VIOLATION = "struct<category:string,description:string,severity:string>"


def _int(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def too_long(n_bytes: Column, max_tokens=MAX_TOKENS) -> Column:
    return n_bytes > _int(max_tokens).cast("long") * BYTES_PER_TOKEN


def input_mask(text: Column, rules: tuple[Rule, ...] = INPUT_RULES) -> Column:
    """One bit per input rule that fires, in rule order; an array of masks where
    there are more rules than one mask holds."""
    return policy_masks(text, rules) if _many(rules) else hit_mask(rules, text, case_folded(text))


def _many(rules: tuple[Rule, ...]) -> bool:
    return len(rules) > MASK_RULES


def has_bits(mask: Column, bits: int) -> Column:
    return mask.bitwiseAND(F.lit(bits).cast("long")) != 0


def violation_count(mask: Column, n_bytes: Column, max_tokens=MAX_TOKENS, rules: tuple[Rule, ...] = INPUT_RULES) -> Column:
    fired = F.aggregate(mask, F.lit(0), lambda n, m: n + F.bit_count(m)) if _many(rules) else F.bit_count(mask)
    return fired.cast("long") + too_long(n_bytes, max_tokens).cast("long")


def is_valid(mask: Column, n_bytes: Column, max_tokens=MAX_TOKENS, rules: tuple[Rule, ...] = INPUT_RULES) -> Column:
    """Any violation of any severity makes the text invalid."""
    clear = ~F.exists(mask, lambda m: m != 0) if _many(rules) else mask == 0
    return clear & ~too_long(n_bytes, max_tokens)


def violations(mask: Column, n_bytes: Column, max_tokens=MAX_TOKENS,
               rules: tuple[Rule, ...] = INPUT_RULES) -> Column:
    """Violations in order: length, injection, code, personal data."""
    limit = _int(max_tokens).cast("long") * BYTES_PER_TOKEN
    length = F.struct(
        F.lit("LENGTH").alias("category"),
        F.format_string("Input exceeds max length (%d > %d)", n_bytes, limit).alias("description"),
        F.lit("high").alias("severity"),
    )
    empty = F.array().cast(f"array<{VIOLATION}>")

    def fired(part: tuple[Rule, ...], bits: Column) -> Column:
        known = F.array(*[
            F.struct(F.lit(1 << i).cast("long").alias("bit"), F.lit(r.category).alias("category"),
                     F.lit(r.description).alias("description"), F.lit(r.severity).alias("severity"))
            for i, r in enumerate(part)
        ])
        found = F.transform(
            F.filter(known, lambda v: bits.bitwiseAND(v["bit"]) != 0),
            lambda v: F.struct(v["category"].alias("category"), v["description"].alias("description"),
                               v["severity"].alias("severity")))
        return F.when(bits != 0, found).otherwise(empty)

    slices = [fired(rules[k:k + SLICE], mask[k // SLICE]) for k in range(0, len(rules), SLICE)] if _many(rules) else [fired(rules, mask)] * bool(rules)
    return F.concat(F.when(too_long(n_bytes, max_tokens), F.array(length)).otherwise(empty), empty, *slices)


def sanitize(text: Column, mask: Column | None = None) -> Column:
    """Personal data replaced rule by rule.  A text in which no such rule fires
    is its own result, so a known *mask* saves the replacements."""
    replaced = replace_in_turn(SANITIZE_RULES, text)
    return replaced if mask is None else F.when(has_bits(mask, PII_BITS), replaced).otherwise(text)


def screen(df: DataFrame, text: str = "text", max_tokens=MAX_TOKENS, rules: tuple[Rule, ...] = INPUT_RULES) -> DataFrame:
    """Adds ``n_bytes``, ``input_mask``, ``n_violations`` and ``valid``."""
    return (
        computed_once(df, "input_mask", input_mask(F.col(text), rules))
        .withColumn("n_bytes", byte_length(F.col(text)))
        .withColumn("n_violations", violation_count(F.col("input_mask"), F.col("n_bytes"), max_tokens, rules))
        .withColumn("valid", is_valid(F.col("input_mask"), F.col("n_bytes"), max_tokens, rules))
    )


def validate(df: DataFrame, text: str = "text", max_tokens=MAX_TOKENS, rules: tuple[Rule, ...] = INPUT_RULES,
             personal: tuple[Rule, ...] = SANITIZE_RULES, token: str = TOKEN) -> DataFrame:
    """Adds ``validation``: struct of valid, sanitized and violations.  Own
    *rules* decide validity, *personal* ones are replaced by
    *token*, in which ``{}`` is the category."""
    mask, size = F.col("input_mask"), F.col("n_bytes")
    fixed = rules == INPUT_RULES and personal == SANITIZE_RULES and token == TOKEN
    clean = sanitize(F.col(text), mask) if fixed else replace_in_turn(personal, F.col(text), token)
    return screen(df, text, max_tokens, rules).withColumn("validation", F.struct(
        F.col("valid").alias("valid"),
        clean.alias("sanitized"),
        violations(mask, size, max_tokens, rules).alias("violations"),
    ))
