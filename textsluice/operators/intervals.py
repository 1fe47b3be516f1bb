"""Joins and running values along an ordered axis, without range joins or
whole-table windows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F


#: Rows that a block of an ordered axis is meant to hold, and the most blocks
#: there are, which is also the rows of the only whole-table window: the one
#: that carries values from block to block.
BLOCK_ROWS, MOST_BLOCKS = 250_000, 2_000
#: Bytes of intervals, as counted, up to which an inner join broadcasts them.
BROADCAST_BYTES = 4 << 20


def in_blocks(df: DataFrame, order: str, blocks: int | None = None) -> DataFrame:
    """Adds ``_block``: which stretch of equally many rows, numbered along
    *order*, the row is in.  Without *blocks* there are as many as the rows
    need.  The cuts are approximate quantiles, so sparse and clustered orders
    give even blocks; equal values share one."""
    fine = MOST_BLOCKS if blocks is None else blocks
    shares = ", ".join(f"{k / fine}D" for k in range(1, fine)) or "0D"
    n, cuts = df.agg(F.count("*"), F.expr(f"percentile_approx(`{order}`, array({shares}), {10 * fine})")).first()
    wanted = fine if blocks is not None else min(fine, -(-n // BLOCK_ROWS))
    splits = sorted({float(cuts[k * fine // wanted - 1]) for k in range(1, wanted)}) if cuts else []
    if not splits:      # a literal would be folded, and joins on it become nested loops
        return df.withColumn("_block", F.when(F.col(order) >= 0, 1.0).otherwise(0.0))
    return Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol=order, outputCol="_block", handleInvalid="keep").transform(df)


def interval_join(df: DataFrame, at: str, intervals: DataFrame, *, start: str = "from_seq",
                  stop: str = "to_seq", how: str = "left", on: Sequence[str] = ()) -> DataFrame:
    """Rows of *df* with the intervals that hold ``start <= at < stop`` (a null
    bound is open) and agree in the columns *on*.  *how*: inner, left_semi, or
    for intervals that do not overlap also left and left_anti.

    An equi-join with the exact bounds as a residual; small intervals are
    broadcast and others shuffled by bin, splitting hot bins at run time.
    Inner and semi joins bin by size: an interval lies in at most two bins of
    the least width (a power of two) that is as long as it is, and a row looks
    once at each width in use, of which there are at most 64.  So long or
    overlapping intervals do not multiply, and clustered ones have narrow bins.
    Pass narrow rows, as they are copied per width; Spark's estimate knows nothing
    of the copies, so intervals are counted and rows never broadcast.  Left and anti joins bin
    equally wide, about one start each; a row is never copied there.
    """
    if how == "inner":
        return _by_size(df, at, intervals, start, stop, on)
    if how == "left_semi" and not on:
        return _by_size(df, at, disjoint(intervals, start, stop), start, stop, ()).select(*df.columns)
    edge = intervals.agg(F.min(start).alias("lo"), F.max(start).alias("hi"),
                         F.count("*").alias("n")).first()
    lo, hi = int(edge["lo"] or 0), int(edge["hi"] or 0)
    step = (hi - lo) // max(1, edge["n"]) + 1

    def bin_of(c: Column) -> Column:
        inside = F.least(F.greatest(c.cast("long"), F.lit(lo)), F.lit(hi)).cast("long")
        return F.floor((inside - lo) / step).cast("long")

    first = bin_of(F.coalesce(F.col(start), F.lit(lo)))
    last = bin_of(F.coalesce(F.col(stop) - 1, F.lit(hi)))
    left = df.withColumn("_bin", bin_of(F.col(at))).alias("l")
    right = intervals.where(_held(start, stop)).withColumn("_bin", F.explode(F.sequence(first, last))).alias("r")
    joined = left.join(right, _meets(at, start, stop, ["_bin", *on]), how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_bin")
    extra = [F.col(f"r.{c}") for c in intervals.columns if c not in (start, stop, *on)]
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], *extra)


def _held(start: str, stop: str) -> Column:
    return F.col(stop).isNull() | F.col(start).isNull() | (F.col(stop) > F.col(start))


def _meets(at: str, start: str, stop: str, equal: Sequence[str]) -> Column:
    bounds = ((F.col(f"r.{start}").isNull() | (F.col(f"l.{at}") >= F.col(f"r.{start}")))
              & (F.col(f"r.{stop}").isNull() | (F.col(f"l.{at}") < F.col(f"r.{stop}"))))
    for c in equal:
        bounds = (F.col(f"l.{c}") == F.col(f"r.{c}")) & bounds
    return bounds


def _by_size(df: DataFrame, at: str, intervals: DataFrame, start: str, stop: str, on: Sequence[str]) -> DataFrame:
    intervals = intervals.where(_held(start, stop))
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in intervals.dtypes if kind == "string"), F.lit(16 * len(intervals.columns)))
    edge = intervals.agg(F.least(F.min(start), F.min(stop)).alias("lo"), F.greatest(F.max(start), F.max(stop)).alias("hi"),
                         F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("size")).first()
    lo, hi = int(edge["lo"] or 0), int(edge["hi"] or 0)
    sized = (intervals.withColumn("_first", F.coalesce(F.col(start), F.lit(lo)) - lo)
             .withColumn("_last", F.coalesce(F.col(stop) - 1, F.lit(hi)) - lo)
             .withColumn("_level", F.when(F.col("_last") <= F.col("_first"), 0)
                         .otherwise(F.length(F.bin(F.col("_last") - F.col("_first")))).cast("int")))
    levels = sorted(r[0] for r in sized.select("_level").distinct().collect())      # at most 64
    right = (sized.withColumn("_bin", F.explode(F.expr("sequence(shiftright(_first, _level), shiftright(_last, _level))")))
             .drop("_first", "_last"))
    right = (F.broadcast(right) if edge["size"] <= BROADCAST_BYTES else right.hint("merge")).alias("r")
    inside = F.least(F.greatest(F.col(at).cast("long"), F.lit(lo)), F.lit(hi)).cast("long") - lo
    looks = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(F.col("_inside"), k).alias("bin")) for k in levels or [0]])
    left = (df.withColumn("_inside", inside).withColumn("_look", F.explode(looks))
            .select(*df.columns, F.col("_look.level").alias("_level"), F.col("_look.bin").alias("_bin")).alias("l"))
    extra = [F.col(f"r.{c}") for c in intervals.columns if c not in (start, stop, *on)]
    return (left.join(right, _meets(at, start, stop, ["_level", "_bin", *on]))
            .select(*[F.col(f"l.{c}") for c in df.columns], *extra))


def disjoint(intervals: DataFrame, start: str, stop: str) -> DataFrame:
    """Intervals (start, stop) that do not overlap and cover the same points:
    each is cut where an earlier one reaches into it."""
    least, most = F.lit(-2**62), F.lit(2**62)
    filled = intervals.select(F.coalesce(F.col(start).cast("long"), least).alias(start), F.coalesce(F.col(stop).cast("long"), most).alias(stop))
    blocked = in_blocks(filled, start)
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocked.groupBy("_block").agg(F.max(stop).alias("_reach")).select("_block", F.max("_reach").over(before).alias("_carried"))
    inside = W.partitionBy("_block").orderBy(start).rowsBetween(W.unboundedPreceding, -1)
    cut = (blocked.withColumn("_inside", F.max(stop).over(inside)).join(carried, "_block")
           .withColumn(start, F.greatest(start, "_inside", "_carried")).where(F.col(start) < F.col(stop)))
    return cut.select(F.when(F.col(start) > least, F.col(start)).alias(start), F.when(F.col(stop) < most, F.col(stop)).alias(stop))


def running_last(df: DataFrame, order: str, columns: list[str], *, blocks: int | None = None) -> DataFrame:
    """Replaces each of *columns* by its last non-null value up to and
    including the row, in order of the unique column *order*.

    Two steps, so no task sees the whole table: values carry inside blocks of
    equally many rows, and the last values of the blocks (one row each) carry
    from block to block.
    """
    blocked = in_blocks(df, order, blocks)
    ends = blocked.groupBy("_block").agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("_block", *[F.last(c, True).over(before).alias(f"_carried_{c}") for c in columns])
    inside = W.partitionBy("_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    filled = blocked.select(
        "_block", *[F.last(c, True).over(inside).alias(c) if c in columns else F.col(c) for c in df.columns])
    return filled.join(carried, "_block", "left").select(
        *[F.coalesce(c, f"_carried_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def running_sums(df: DataFrame, order: str, columns: Sequence[str], *, keys: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Replaces each of *columns* by its sum over the rows of the same *keys* up
    to and including the row, in *order*.

    As in :func:`running_last`, sums run inside blocks and the totals of the
    blocks (one row per block and key) from block to block, so neither a long
    log nor a frequent key meets in one task.  *df* is read three times: pass
    narrow rows that are already written.  Keys must not be null; rows of equal
    order get their sums in any order.
    """
    blocked = in_blocks(df, order, blocks)
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = blocked.groupBy(*keys, "_block").agg(*[F.sum(c).alias(c) for c in columns])
    carried = totals.select(*keys, "_block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_carried_{c}") for c in columns])
    inside = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    summed = blocked.select("_block", *[F.sum(c).over(inside).alias(c) if c in columns else F.col(c) for c in df.columns])
    return summed.join(carried, [*keys, "_block"]).select(
        *[(F.col(c) + F.col(f"_carried_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def running_total(df: DataFrame, keys: list[str], us: str, seq: str, *, amount: Column | None = None,
                  slot_us: int = 60_000_000, name: str = "running") -> DataFrame:
    """Adds the running sum of *amount* (default 1 per row) per *keys* in the
    order of (*us*, *seq*).

    Summed inside short time slots, with the totals of earlier slots joined on,
    so a key that holds much of the table is spread over its slots.
    """
    amount = F.lit(1) if amount is None else amount
    slotted = df.withColumn("_amount", amount.cast("long")).withColumn("_slot", F.expr(f"{us} div {int(slot_us)}"))
    earlier = W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    before = (slotted.groupBy(*keys, "_slot").agg(F.sum("_amount").alias("_sum"))
              .select(*keys, "_slot", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")))
    inside = W.partitionBy(*keys, "_slot").orderBy(us, seq).rowsBetween(W.unboundedPreceding, 0)
    return (slotted.withColumn("_inside", F.sum("_amount").over(inside)).join(before, [*keys, "_slot"])
            .withColumn(name, F.col("_before") + F.col("_inside")).select(*df.columns, name))
