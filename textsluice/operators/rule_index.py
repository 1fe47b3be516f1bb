"""Many rules on many texts: an inverted index of what matches must contain.

Every pattern has literals of which each match holds one.  A few letters of
each literal, a gram, make the index (gram, pattern); texts look up the grams
they hold, and only the pairs found are matched.  Rules stay a table: none is
in the plan and none is read by the driver, which sees a bitmap of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.dialect import to_java
from ..functions.literals import rarest, required
from ..functions.matching import case_folded

#: Letters of a gram: long for literals that have so many, else short.  A rule
#: with a literal shorter than that is tried on every text.
LONG, SHORT = 6, 3
#: The gram that every text has.
ANY = -1
#: Bits of the map of grams in use, by which texts choose what they look up.
MAP_BITS = 20
#: Bytes of a text looked at a time.
SLICE = 1 << 20


def _code(gram: bytes) -> int:
    """A gram as a number; those of the two lengths differ."""
    return int.from_bytes(gram, "big") | (len(gram) == LONG) << 50


def grams(pattern: str) -> list[int]:
    """The grams of which a text must hold one to match."""
    literals = required(pattern) or {""}
    if min(map(len, literals)) < SHORT:
        return [ANY]
    return sorted({_code(rarest(x, LONG if len(x) >= LONG else SHORT).encode()) for x in literals})


@F.pandas_udf(T.StructType([T.StructField("java", T.StringType()), T.StructField("grams", T.ArrayType(T.LongType()))]))
def _form(patterns: pd.Series) -> pd.DataFrame:
    """Java form and grams of each pattern, nulls where it is not valid."""
    def form(pattern):
        try:
            return (None, None) if pattern is None else (to_java(pattern), grams(pattern))
        except ValueError:
            return None, None
    known = {p: form(p) for p in patterns.unique()}
    return pd.DataFrame([known[p] for p in patterns], columns=["java", "grams"])


def rule_index(rules: DataFrame) -> DataFrame:
    """(gram, pattern, java): every distinct valid pattern of *rules*, by grams."""
    formed = rules.select("pattern").distinct().withColumn("f", _form("pattern")).where(F.col("f.java").isNotNull())
    return formed.select(F.explode("f.grams").alias("gram"), "pattern", F.col("f.java").alias("java"))


def _bit(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MAP_BITS)


def _map_of(index: DataFrame) -> np.ndarray:
    """Which grams are in use: a bitmap that stays the same size however many
    rules there are.  Full maps only make texts look up more."""
    @F.pandas_udf("long")
    def bit(codes: pd.Series) -> pd.Series:
        return pd.Series(_bit(codes.to_numpy(np.int64)).astype(np.int64))

    words = (index.select("gram").distinct().withColumn("b", bit("gram"))
             .groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 AS int))")).alias("m")))
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    for r in words.collect():       # 2^14 words at most
        out[r["w"]] = np.uint64(r["m"] & 0xFFFFFFFFFFFFFFFF)
    return out


def _held(text: bytes, used: np.ndarray) -> np.ndarray:
    """The grams of a text that may be in use, once each."""
    found = []
    for at in range(0, max(1, len(text)), SLICE):
        part = np.frombuffer(text[at:at + SLICE + LONG - 1], np.uint8).astype(np.int64)
        for n in (SHORT, LONG):
            size = len(part) - n + 1
            if size < 1:
                continue
            codes = np.full(size, int(n == LONG) << 50, np.int64)
            for k in range(n):
                codes |= part[k:k + size] << (8 * (n - 1 - k))
            bit = _bit(codes)
            found.append(np.unique(codes[(used[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)]))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def candidates(df: DataFrame, index: DataFrame, text: str = "text") -> DataFrame:
    """The rows of *df* with the patterns that may match them (``pattern``,
    ``java``); a pair found by several grams stands several times.

    Spark broadcasts the index where it is small and otherwise shuffles by gram.
    """
    index = index.persist()
    used = _map_of(index)
    every = bool(used[_bit(np.array([ANY]))[0] >> np.uint64(6)] >> (_bit(np.array([ANY]))[0] & np.uint64(63)) & np.uint64(1))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def looked_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        always = np.array([ANY] * every, np.int64)
        for texts in batches:
            yield pd.Series([always if t is None else np.concatenate([always, _held(t.encode(), used)]) for t in texts])

    asked = df.withColumn("_gram", F.explode(looked_up(case_folded(F.col(text)))))
    return asked.join(index.withColumnRenamed("gram", "_gram"), "_gram").drop("_gram")


def pattern_hits(df: DataFrame, rules: DataFrame, *ids: str, text: str = "text") -> DataFrame:
    """(ids, pattern) for every row and every distinct valid pattern of *rules*
    (pattern) that its text holds.  A null text holds none."""
    rows = df.select(*ids, F.col(text).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    found = candidates(rows, rule_index(rules), "_text").where(F.expr("_text RLIKE java"))
    return found.select("_row", *ids, "pattern").dropDuplicates(["_row", "pattern"]).drop("_row")
