"""How filters overlap: a sparse document-term matrix, flags of five filters, and all their orders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textsluice.llm.common import as_bytes, bytes_of, from_bytes, kept, map_in_arrow, portions, word_slices

FILTERS = "ABCDE"
#: Words of texts that one shard of the matrix holds, or those of one longer text.
SHARD_WORDS = 1 << 21
#: Distinct words of one shard, which bounds its own dictionary.
SHARD_TERMS = 1 << 18
#: Parts that the dictionary is numbered in; ids are dense but for their unevenness.
BUCKETS = 1 << 16
#: Copies of a repeated text's row, so that a text that a third of all rows hold spreads over tasks.
SALTS = 32

UPPER = bytes(range(ord("A"), ord("Z") + 1))
LATER_BYTES = bytes(range(0x80, 0xC0))      # bytes of a character after its first
SIGNS = b"#$%&*|"

#: A shard: its columns as one Arrow batch, and its own dictionary.
LOCAL = "shard long, body binary, words array<string>"
GLOBAL = ("shard long, doc_id array<bigint>, part array<string>, flags array<int>, digest array<binary>, row_stop array<int>, "
          "data array<int>, indices array<bigint>")
FIGURES = "doc_id long, part string, digest binary, flags int, n_words long, n_distinct long, salt int"


def _planes(a: np.ndarray) -> bytes:
    """32-bit numbers with their lowest bytes first, then the next ones: the upper
    bytes of small numbers are runs of zeros, which files and shuffles squeeze."""
    return np.ascontiguousarray(a.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


class _Terms(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Shard:
    def __init__(self):
        self.terms, self.words, self.stops = _Terms(), 0, 0
        self.doc_id, self.part, self.flags, self.digest = [], [], [], []
        self.row_stop, self.indices, self.data = [], [], []

    def add(self, ids: list, parts: list, texts: list[bytes]) -> None:
        known, found, sizes = self.terms.__getitem__, [], []
        for text in texts:
            numbers = [np.fromiter(map(known, w), np.int64, len(w)) for w in map(bytes.split, word_slices(text))]
            found += numbers
            sizes.append(sum(map(len, numbers)))
            upper, later, signs = (len(text) - len(text.translate(None, x)) for x in (UPPER, LATER_BYTES, SIGNS))
            self.flags.append(4 * (100 * upper > 10 * (len(text) - later)) + 8 * (signs > 0))
            self.digest.append(hashlib.sha256(text).digest())
        width = max(1, len(self.terms))
        row = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
        cell, uses = np.unique(row * width + np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
        stops = self.stops + np.cumsum(np.bincount(cell // width, minlength=len(texts)))
        self.stops = int(stops[-1]) if len(stops) else self.stops
        self.row_stop.append(stops.astype(np.int32))
        self.indices.append((cell % width).astype(np.int32))
        self.data.append(uses.astype(np.int32))
        self.doc_id += ids
        self.part += parts
        self.words += sum(sizes)

    def row(self, shard: int) -> pa.RecordBatch:
        columns = {"doc_id": pa.array(self.doc_id, pa.int64()), "part": pa.array(self.part, pa.string()), "flags": pa.array(self.flags, pa.int32()),
                   "digest": pa.array(self.digest, pa.binary()), "row_stop": pa.array(np.concatenate(self.row_stop)),
                   "data": pa.array([_planes(np.concatenate(self.data))], pa.binary()),
                   # a row's indices rise, so their steps are small
                   "indices": pa.array([_planes(np.diff(np.concatenate(self.indices), prepend=0))], pa.binary())}
        body = as_bytes(pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(a)], a) for a in columns.values()], names=list(columns)))
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([body], pa.binary()), pa.array([list(self.terms)], pa.list_(pa.string()))],
                                          names=["shard", "body", "words"])


def _local_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, shard = TaskContext.get().partitionId() << 32, _Shard()
    for batch in (part for batch in batches for part in portions(batch, 2)):
        shard.add(*(batch.column(k).to_pylist() for k in range(3)))
        if shard.words >= SHARD_WORDS or len(shard.terms) >= SHARD_TERMS:
            yield shard.row(number)
            number, shard = number + 1, _Shard()
    if shard.doc_id:
        yield shard.row(number)


def local_shards(docs: DataFrame) -> DataFrame:
    """CSR shards of documents where they are read, words numbered per shard."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), bytes_of("text").alias("text"))
    return map_in_arrow(rows, _local_shards, LOCAL)


def dictionary(shards: DataFrame) -> DataFrame:
    """(shard, at, id): the global id of every word of every shard's dictionary.

    A word stands once in each shard it occurs in, so no word makes a hot key.
    Equal words get one id by their rank in a hash bucket.
    """
    words = shards.select("shard", F.posexplode("words").alias("at", "word")).withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)))
    rank = F.dense_rank().over(W.partitionBy("bucket").orderBy("word")).cast("long")
    return words.select("shard", "at", ((rank - 1) * BUCKETS + F.col("bucket")).alias("id"))


def _renumbered(shard: pa.Table, ids: pa.Table) -> dict[str, pa.Array]:
    """A shard's columns with global ids."""
    by_at = np.zeros(ids.num_rows, np.int64)
    by_at[ids.column("at").to_numpy()] = ids.column("id").to_numpy()
    body = from_bytes(shard.column("body")[0].as_buffer())
    columns = {name: body.column(name).flatten() for name in body.schema.names}
    indices = np.cumsum(_from_planes(columns["indices"][0].as_py()), dtype=np.int64)
    return columns | {"data": pa.array(_from_planes(columns["data"][0].as_py())), "indices": pa.array(by_at[indices])}


def _shard_row(shard: pa.Table, ids: pa.Table) -> pa.Table:
    columns = _renumbered(shard, ids)
    return pa.table([shard.column("shard"), *[pa.ListArray.from_arrays([0, len(a)], a) for a in columns.values()]], names=["shard", *columns])


def _row_figures(shard: pa.Table, ids: pa.Table) -> pa.Table:
    """Row sums, distinct ids of each row, and the flags they decide."""
    row = _renumbered(shard, ids)
    stop = row["row_stop"].to_numpy().astype(np.int64)
    start = np.concatenate([[0], stop[:-1]])
    uses = np.concatenate([[0], np.cumsum(row["data"].to_numpy(), dtype=np.int64)])
    cell = np.concatenate([[0], np.cumsum(row["data"].to_numpy() > 0)])
    words, distinct = uses[stop] - uses[start], cell[stop] - cell[start]
    flags = row["flags"].to_numpy() | (words < 100) | (100 * distinct < 80 * words) * 2
    return pa.table([row["doc_id"], row["part"], row["digest"], pa.array(flags.astype(np.int32)), pa.array(words), pa.array(distinct),
                     pa.array(np.arange(len(stop), dtype=np.int32) % SALTS)],
                    names=["doc_id", "part", "digest", "flags", "n_words", "n_distinct", "salt"])


def _by_shard(docs: DataFrame, fn, schema: str) -> DataFrame:
    shards = kept(local_shards(docs), "csr-shards")
    return shards.select("shard", "body").groupBy("shard").cogroup(dictionary(shards).groupBy("shard")).applyInArrow(fn, schema)


def matrix(docs: DataFrame) -> DataFrame:
    """The document-term matrix of (doc_id, text, lang) as CSR shards.

    A row is a shard: of each document its id, part (lang), flags of the filters
    that look at characters, digest of the text and where its row stops; the
    cells are ``indices`` (global ids of words) and ``data`` (uses).
    """
    return _by_shard(docs, _shard_row, GLOBAL)


def flagged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, n_words, n_distinct, flags) of every row: row sums and
    cells of its row of the matrix, and one bit per filter that it fails."""
    rows = kept(_by_shard(docs, _row_figures, FIGURES), "row-figures")
    # only texts that occur twice are joined back, each copied per salt
    first = (rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")
             .select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(first, ["digest", "salt"], "left").select(
        "doc_id", "part", "n_words", "n_distinct", (F.col("flags") + F.when(again, 16).otherwise(0)).alias("flags"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, flags, n, good, toxic): documents by the set of filters they fail."""
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    return flagged(docs).join(marks, "doc_id", "left").groupBy("part", "flags").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("_good"), F.lit(0)).alias("good"), F.coalesce(F.sum("_toxic"), F.lit(0)).alias("toxic"))


def _steps() -> Column:
    """All orders and steps: order, step, the step's filter as a bit, the filters before it."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            steps.append(f"('{''.join(FILTERS[x] for x in order)}', {k + 1}, {1 << f}, {before})")
            before |= 1 << f
    kind = "array<struct<filter_order:string,step:int,bit:int,before:int>>"
    return F.expr(f"cast(array({', '.join(steps)}) as {kind})")


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, with the counts of
    documents kept, removed, redundant, failing this filter alone, and lost.

    A null text is empty, a null lang the empty string.  Rows with repeated ids
    count each; a row without an id equals no smaller one and bears no label; of
    repeated labels of an id one that says 1 is enough.  An empty table gives no
    rows; other columns are not read.
    """
    by_part = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("flags", "n", "good", "toxic")).alias("cells"))   # 32 at most
    at = by_part.withColumn("s", F.explode(_steps())).select("part", "cells", "s.*")
    fails, gone = "(c.flags & bit) != 0", "(c.flags & before) != 0"

    def total(where: str, what: str = "n") -> Column:
        return F.expr(f"aggregate(cells, 0L, (a, c) -> a + if({where}, c.{what}, 0L))")

    # a document is removed by its filter f in 120 / (filters it fails) of the orders
    shapley = F.expr(f"aggregate(cells, 0L, (a, c) -> a + if({fails}, c.n * 120L div greatest(1, bit_count(c.flags)), 0L))")
    return at.select("part", "filter_order", "step", total("(c.flags & (before | bit)) = 0").alias("kept"),
                     total(f"{fails} and not ({gone})").alias("removed"), total(f"{fails} and {gone}").alias("redundant"),
                     total("c.flags = bit").alias("unique_fails"), total(f"{fails} and not ({gone})", "good").alias("good_lost"),
                     total(f"{fails} and not ({gone})", "toxic").alias("toxic_lost"), shapley.alias("shapley"))
