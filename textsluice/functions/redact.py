"""Output redaction: secrets first, then personal data on what is left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .dialect import to_java
from .matching import TOKEN, case_folded, computed_once, may_hit, replace_in_turn
from .rules import OUTPUT_PII_RULES, SECRET_RULES, Rule

REDACTION = "struct<category:string,original_length:int>"


def _found(rule: Rule, text: Column, folded: Column) -> Column:
    def entry(match):
        return F.struct(F.lit(rule.category).alias("category"),
                        F.octet_length(match).alias("original_length"))

    found = F.transform(
        F.regexp_extract_all(text, F.lit(to_java(rule.pattern, rule.starts)), F.lit(0)), entry)
    guard = may_hit(rule, text, folded)
    return found if guard is None else F.when(guard, found).otherwise(_nothing())


def _nothing() -> Column:
    return F.array().cast(f"array<{REDACTION}>")


def found_in(rules: Sequence[Rule], text: Column, folded: Column) -> Column:
    """Every match of every rule in *text*, rule order then match order."""
    return F.concat(_nothing(), *[_found(r, text, folded) for r in rules])


def redact(df: DataFrame, text: str = "text", *, enabled: bool = True,
           secrets: Sequence[Rule] = SECRET_RULES,
           personal: Sequence[Rule] = OUTPUT_PII_RULES, token: str = TOKEN) -> DataFrame:
    """Adds ``redacted`` (the new text), ``redactions`` and ``modified``.

    Secrets are listed from the original text and personal data from the text
    left by the secret pass; overlapping rules may list one span twice.  A pass
    that lists nothing changes nothing, so replacements run only on texts with
    hits.  *token* is what a match becomes, ``{}`` in it the category.  With ``enabled=False`` the text is passed through, unlisted.
    """
    if not enabled:
        return (df.withColumn("redacted", F.col(text))
                .withColumn("redactions", F.lit(None).cast(f"array<{REDACTION}>"))
                .withColumn("modified", F.lit(False)))
    original, left = F.col(text), F.col("_left")
    df = df.withColumn("_folded", case_folded(original))
    df = computed_once(df, "_secrets", found_in(secrets, original, F.col("_folded")))
    df = computed_once(df, "_left", F.when(F.size("_secrets") > 0, replace_in_turn(secrets, original, token)).otherwise(original))
    df = computed_once(df, "_personal", found_in(personal, left, case_folded(left)))
    return (
        df.withColumn("redacted", F.when(F.size("_personal") > 0, replace_in_turn(personal, left, token)).otherwise(left))
        .withColumn("redactions", F.concat("_secrets", "_personal"))
        .withColumn("modified", F.size("redactions") > 0)
        .drop("_folded", "_secrets", "_left", "_personal")
    )
