"""Exact nearest binary codes by incremental multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from textsluice.llm.common import arrow_map, kept, sliced

K = 10
#: A code of 64 bits in segments of 16.
BITS, SEGMENTS, WIDTH = 64, 4, 16
#: Index entries of a bucket, about; the number of buckets follows the data.
BUCKET = 500_000
#: Pairs compared at a time.
PAIRS = 4_000_000


def codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, code): bit i is set where component i is above zero.

    A null or short vector has zeros for what it lacks; components beyond the
    64th don't count.
    """
    v = F.coalesce(F.col(embedding), F.array().cast("array<float>"))
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(
        F.when(F.get(v, i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), bits.alias("code"))


def _segment(code: np.ndarray, s: int) -> np.ndarray:
    return code >> np.uint64(WIDTH * s) & np.uint64((1 << WIDTH) - 1)


def _packed(keys: np.ndarray, buckets: int, columns: list[np.ndarray], names: list[str]) -> Iterable[pa.RecordBatch]:
    order = np.argsort(keys, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys[order])) + 1, [len(order)]])
    spans = [(i, j) for i, j in zip(cuts[:-1], cuts[1:]) if j > i]
    yield from sliced([np.array([keys[order[i]] for i, _ in spans], np.int64),
                       *[pa.array([c[order[i:j]].tobytes() for i, j in spans], pa.binary()) for c in columns]], ["bucket", *names])


def _indexed(buckets: int):
    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        code, least = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
        for s in range(SEGMENTS):
            yield from _packed(s * buckets + (_segment(code, s) % np.uint64(buckets)).astype(np.int64), buckets, [code, least], ["codes", "least"])
    return run


def _probes(radius: int, buckets: int):
    flips = np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), radius)], np.uint64)

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        every = batch.column(0).to_numpy().view(np.uint64)
        step = max(1, 1_000_000 // len(flips))
        for at in range(0, len(every), step):
            query = every[at:at + step]
            for s in range(SEGMENTS):
                value = (_segment(query, s)[:, None] ^ flips[None, :]).ravel()
                yield from _packed(s * buckets + (value % np.uint64(buckets)).astype(np.int64), buckets,
                                   [np.repeat(query, len(flips)), value.astype(np.uint16)], ["queries", "values"])
    return run


def _compare(k: int, buckets: int):
    names = ["query", "code", "distance", "least"]

    def best(q: np.ndarray, c: np.ndarray, d: np.ndarray, least: np.ndarray):
        order = np.lexsort([least, d, q])
        q, c, d, least = q[order], c[order], d[order], least[order]
        begin = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
        rank = np.arange(len(q)) - np.flatnonzero(begin)[np.cumsum(begin) - 1] if len(q) else np.zeros(0)
        return tuple(x[rank < k] for x in (q, c, d, least))

    def run(probes: pa.Table, index: pa.Table) -> pa.Table:
        join = lambda t, n, kind: np.frombuffer(b"".join(t.column(n).to_pylist()), kind)
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        held = none
        if probes.num_rows and index.num_rows:
            s = probes.column("bucket")[0].as_py() // buckets
            code, least = join(index, "codes", np.uint64), join(index, "least", np.int64)
            order = np.argsort(_segment(code, s), kind="stable")
            code, least = code[order], least[order]
            have = _segment(code, s)
            query, value = join(probes, "queries", np.uint64), join(probes, "values", np.uint16).astype(np.uint64)
            low, high = np.searchsorted(have, value), np.searchsorted(have, value, side="right")
            full = high > low
            query, low, size = query[full], low[full], (high - low)[full]
            turn = np.argsort(query, kind="stable")
            query, low, size = query[turn], low[turn], size[turn]
            until = np.cumsum(size)
            at = 0
            while at < len(query):
                end = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + PAIRS, side="right")))
                n = size[at:end]
                pick = np.repeat(low[at:end] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                q, c = np.repeat(query[at:end], n), code[pick]
                new = (q, c, np.bitwise_count(q ^ c).astype(np.int64), least[pick])
                held = best(*(np.concatenate([x, y]) for x, y in zip(held, new)))
                at = end
        return pa.table(dict(zip(names, (held[0].view(np.int64), held[1].view(np.int64), held[2], held[3]))))
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, distance): the ``k`` rows of ``vectors`` (vec_id, code)
    nearest to every row of ``queries`` (vec_id, code), itself among them; equal
    distances go by id.

    Codes are cut into segments.  In round r all segments are searched at radius
    r; then every code within ``SEGMENTS * (r + 1) - 1`` bits has been seen, and a
    query whose k-th verified distance is not above that is finished.  The others
    go on until every radius of a segment is searched.

    Equal codes are indexed once with their ``k`` smallest ids, so copies make no
    hot key; buckets are compared inside tasks, which pass on ``k`` codes a query.
    Rows without an id take no part; an empty table gives no rows.
    """
    rank = F.row_number().over(W.partitionBy("code").orderBy("vec_id"))
    ids = kept(vectors.where("vec_id is not null").withColumn("r", rank).where(F.col("r") <= k), "codes")
    index = ids.groupBy("code").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    index = kept(index, "index")
    asked = kept(queries.where("vec_id is not null").select("vec_id", "code"), "queries")
    buckets = max(8, -(-index.count() // BUCKET))
    spread = kept(arrow_map(index.select("code", "least"), _indexed(buckets), "bucket long, codes binary, least binary"), "buckets")
    active, found, done = kept(asked.select("code").distinct(), "active"), None, None
    for radius in range(WIDTH + 1):
        probes = arrow_map(active, _probes(radius, buckets), "bucket long, queries binary, values binary")
        new = probes.groupBy("bucket").cogroup(spread.groupBy("bucket")).applyInArrow(_compare(k, buckets), "query long, code long, distance long, least long")
        if found is not None:
            new = new.unionByName(found)
        new = new.distinct().withColumn("r", F.row_number().over(W.partitionBy("query").orderBy("distance", "least"))).where(F.col("r") <= k)
        new = kept(new.drop("r"), "found")
        seen = new.join(index.select("code", "n"), "code")
        until = F.sum("n").over(W.partitionBy("query").orderBy("distance", "least").rowsBetween(W.unboundedPreceding, 0))
        covered = SEGMENTS * (radius + 1) - 1
        ready = seen.withColumn("until", until).groupBy("query").agg(F.min(F.when(F.col("until") >= k, F.col("distance"))).alias("kth"))
        ready = kept(ready.where((F.col("kth") <= covered) | F.lit(radius == WIDTH)).select("query"), "ready")
        finished = new.join(ready, "query", "left_semi")
        done = finished if done is None else done.unionByName(finished)
        found = new.join(ready, "query", "left_anti")
        active = kept(active.join(ready, active.code == ready["query"], "left_anti"), "active")
        if not active.take(1):
            break
    rows = asked.select(F.col("vec_id").alias("query_id"), F.col("code").alias("query"))
    near = rows.join(done.select("query", "code", "distance"), "query").join(ids.select("code", "vec_id"), "code")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
    return near.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
