"""Sharding by fixed virtual slots, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from textsluice.llm.common import kept

#: Virtual slots; fixed for the life of a data set, many times the shards.
SLOTS = 4096


def slot_of(doc_id: str = "doc_id", slots: int = SLOTS) -> Column:
    """The slot of a record: a hash of its id alone."""
    return F.pmod(F.xxhash64(doc_id), F.lit(slots)).cast("int")


def records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot): what sharding needs of a document."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col(text).cast("binary"), F.lit(b""))).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"),
                       slot_of(doc_id, slots).alias("vslot"))


def slot_bytes(recs: DataFrame) -> DataFrame:
    """(vslot, bytes, rows): at most one row per slot, summed before the shuffle."""
    return recs.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _dealt(loads: DataFrame, start: Column) -> DataFrame:
    """Deals slots (vslot, bytes) in falling order of bytes, each to the least
    loaded shard; ``start`` is the array of loads that shards begin with.  The
    table has at most one row per slot, so its one group is bounded."""
    step = lambda acc, s: F.struct(
        F.transform(acc["loads"], lambda x, i: x + F.when(i + 1 == F.array_position(acc["loads"], F.array_min(acc["loads"])), s["bytes"]).otherwise(0)).alias("loads"),
        F.concat(acc["dealt"], F.array(F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1)).alias("dealt"))
    every = loads.agg(F.sort_array(F.collect_list(F.struct(F.col("bytes"), F.col("vslot"))), asc=False).alias("s"))
    done = every.select("s", F.aggregate("s", F.struct(start.alias("loads"), F.expr("cast(array() as array<int>)").alias("dealt")),
                                         step)["dealt"].alias("dealt"))
    return (done.select(F.posexplode(F.arrays_zip(F.col("s.vslot").alias("vslot"), F.col("dealt").alias("shard"))).alias("at", "x"))
            .select("x.vslot", "x.shard"))


def first_map(loads: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """(version, vslot, shard) for all slots: filled ones by falling bytes to
    the least loaded shard, empty ones in turn."""
    filled = _dealt(loads.select("vslot", "bytes"), F.array_repeat(F.lit(0).cast("long"), shards))
    every = loads.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return (every.join(filled, "vslot", "left")
            .select(F.lit(1).alias("version"), "vslot", F.coalesce("shard", F.pmod("vslot", F.lit(shards))).cast("int").alias("shard")))


def rebalanced(old: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for more shards.

    Every shard keeps its slots up to its new share of bytes; slots beyond it go
    to new shards, so no record moves between old ones.
    """
    sized = old.join(loads.select("vslot", "bytes"), "vslot", "left").fillna(0, ["bytes"])
    share = sized.agg((F.sum("bytes") / shards).alias("share"), (F.max("shard") + 1).alias("had"))
    running = F.sum("bytes").over(W.partitionBy("shard").orderBy(F.col("bytes").desc(), "vslot").rowsBetween(W.unboundedPreceding, 0))
    at = sized.withColumn("until", running).join(F.broadcast(share))     # one row
    moved = at.where((F.col("until") > F.col("share")) & (F.col("bytes") > 0))
    had = old.agg(F.max("shard")).first()[0] + 1
    dealt = _dealt(moved.select("vslot", "bytes"), F.array_repeat(F.lit(0).cast("long"), max(1, shards - had)))
    new = dealt.select("vslot", (F.col("shard") + had).cast("int").alias("moved_to"))
    return (old.join(new, "vslot", "left")
            .select((F.col("version") + 1).alias("version"), "vslot", F.coalesce("moved_to", "shard").alias("shard")))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Adds a version to the stored map; older versions stay readable."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the newest by default."""
    stored = spark.read.parquet(path).select("version", "vslot", "shard")
    version = stored.agg(F.max("version")).first()[0] if version is None else version
    return stored.where(F.col("version") == version)


def placed(recs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records with their shard and their place in it, counted from 0.

    Places are counted inside virtual slots and moved by the rows of the slots
    before, so no task sorts a whole shard.  The map and the counts have one row
    per slot, so they are bounded and broadcast.
    """
    sized = slot_map.join(recs.groupBy("vslot").agg(F.count("*").alias("rows")), "vslot", "left").fillna(0, ["rows"])
    before = F.sum("rows").over(W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1))
    lookup = sized.select("vslot", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return (recs.withColumn("inside", inside).join(F.broadcast(lookup), "vslot")
            .withColumn("slot", F.col("before") + F.col("inside") - 1).drop("before", "inside"))


def sharded(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, vslot, shard, slot) of every row.

    Sizes of shards are near equal: they differ by no more than the largest slot.
    A null text has size 1 and the checksum of no bytes; rows without an id share
    a slot; rows with equal ids stay together; an empty table gives no rows.
    """
    recs = kept(records(docs, doc_id, text), "records")
    slot_map = kept(first_map(slot_bytes(recs), shards), "slot-map")
    return placed(recs, slot_map)
