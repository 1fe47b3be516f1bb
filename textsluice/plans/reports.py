"""Report plans over whole text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import detect
from ..functions.matching import exploded
from ..functions.redact import redact
from ..functions.rules import INPUT_RULES


def redaction_report(texts: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """Hits and hit bytes per category and *by* columns: one scan, one partial
    aggregation, a shuffle of one row per category and group."""
    found = exploded(redact(texts.select(*by, text), text), [*by], F.col("redactions"), "r")
    return found.groupBy(*by, F.col("r.category").alias("category")).agg(
        F.count("*").alias("hits"), F.sum(F.col("r.original_length").cast("long")).alias("hit_bytes"))


def rule_report(texts: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """Texts hit per input rule and *by* columns."""
    screened = texts.select(*by, detect.input_mask(F.col(text)).alias("input_mask"))
    counted = screened.groupBy(*by).agg(*[
        F.count_if(detect.has_bits(F.col("input_mask"), 1 << i)).alias(f"_{i}") for i in range(len(INPUT_RULES))])
    rows = F.array(*[
        F.struct(F.lit(i).cast("long").alias("rule"), F.lit(r.category).alias("category"),
                 F.lit(r.description).alias("description"), F.col(f"_{i}").alias("texts"))
        for i, r in enumerate(INPUT_RULES)])
    return counted.select(*by, F.inline(rows)).where(F.col("texts") > 0)


def validation_summary(texts: DataFrame, *by: str, text: str = "text", max_tokens: int) -> DataFrame:
    """Texts, invalid texts and texts per violation category."""
    mask, size = F.col("input_mask"), F.col("n_bytes")
    screened = detect.screen(texts.select(*by, text), text, max_tokens)
    return screened.groupBy(*by).agg(
        F.count("*").alias("texts"), F.count_if(~F.col("valid")).alias("invalid"),
        F.sum("n_violations").alias("violations"),
        F.count_if(detect.too_long(size, max_tokens)).alias("too_long"),
        *[F.count_if(detect.has_bits(mask, bits)).alias(category.lower())
          for category, bits in detect.CATEGORY_BITS.items()])
