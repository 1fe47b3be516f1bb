"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textsluice.llm.common import arrow_map, bytes_of, forget, kept, mixed, sliced, text_map
from textsluice.llm.components import components, local_roots

WORDS, SEED, RADIUS = 3, 42, 3
#: Bits of shingle hashes counted at a time.
BLOCK = 1 << 16
#: Variants in a bucket, about; the number of buckets follows the data.
BUCKET = 2_000_000
#: Fingerprints expanded at a time.
AT_ONCE = 4_000

_ONE = [1 << i for i in range(64)]
_TWO = [1 << i | 1 << j for i in range(64) for j in range(i) if i // 32 == j // 32]
#: Flips of a variant by number: none, one bit, two bits of the same half.
FLIPS = np.array([0, *_ONE, *_TWO], np.uint64)
SHORT = 1 + len(_ONE)


def fingerprint(text: bytes) -> int:
    """SimHash of a text's 3-word shingles; A-Z lower-cased, repeats counted."""
    import xxhash

    words = text.lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    parts = map(join, zip(words, words[1:], words[2:])) if len(words) >= WORDS else [join(words)] if words else []
    hashes = np.fromiter((digest(p, SEED) for p in parts), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at:at + BLOCK].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little") if len(hashes) else np.zeros(8, np.uint8)
    return int(bits.view("<i8")[0])


def _fingerprints(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
    prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.int64)
    yield from sliced([batch.column(0), prints], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; a null or wordless text has fingerprint zero."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), bytes_of(text).alias("text"))
    return text_map(rows, _fingerprints, "doc_id long, fp long", 1)


def _variants(buckets: int):
    def expand(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        every = batch.column(0).to_numpy().view(np.uint64)
        odd = (np.bitwise_count(every) & 1).astype(bool)
        for group, flips in ((every[~odd], FLIPS[:SHORT]), (every[odd], FLIPS)):
            for at in range(0, len(group), AT_ONCE):
                prints = group[at:at + AT_ONCE]
                bucket = (mixed(prints[:, None] ^ flips[None, :]).ravel() % np.uint64(buckets)).astype(np.uint32)
                order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
                who, flip = np.divmod(order, len(flips))
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1)) if buckets < len(order) else None
                if edges is None:
                    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                    edges = np.concatenate([[0], cuts, [len(order)]])
                held = prints[who]
                flip = flip.astype(np.uint16)
                spans = [(i, j) for i, j in zip(edges[:-1], edges[1:]) if j > i]
                ids = np.array([bucket[order[i]] for i, _ in spans], np.int64)
                yield from sliced([ids, pa.array([held[i:j].tobytes() for i, j in spans], pa.binary()),
                                   pa.array([flip[i:j].tobytes() for i, j in spans], pa.binary())], ["bucket", "prints", "flips"])
    return expand


def hub_links(prints: np.ndarray, flips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from the members of every shared variant to one of them.

    All who share a variant are within the radius of an even member, or of the
    variant itself, or (variant even) of each other.  A variant shared only by
    odd fingerprints that flipped two bits shows no link: those two bits apart
    meet in an even variant too.
    """
    variants = prints ^ FLIPS[flips]
    order = np.argsort(variants)
    seen = variants[order]
    same = seen[1:] == seen[:-1]
    shared = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    p, v, own = prints[shared], variants[shared], flips[shared] == 0
    odd, odd_v = (np.bitwise_count(p) & 1).astype(bool), (np.bitwise_count(v) & 1).astype(bool)
    rank = np.lexsort([p, ~own, odd, v])
    p, v, own, odd, odd_v = (x[rank] for x in (p, v, own, odd, odd_v))
    first = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
    lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(v) else np.zeros(0, np.int64)
    fit = ~first & (~odd[lead] | own[lead] | ~odd_v)
    a, b = p[fit], p[lead][fit]
    near = np.bitwise_count(a ^ b) <= RADIUS
    return a[near], b[near]


def _links(table: pa.Table) -> pa.Table:
    join = lambda k, kind: np.frombuffer(b"".join(table.column(k).to_pylist()), kind)
    a, b = hub_links(join("prints", np.uint64), join("flips", np.uint16))
    nodes, roots = local_roots(a.view(np.int64), b.view(np.int64))
    out = nodes != roots
    return pa.table({"a": nodes[out], "b": roots[out]})


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): fingerprints at most 3 bits apart are linked.

    Two fingerprints three bits apart differ in parity, so even ones emit the
    ball of radius one and odd ones that of radius two: half the radius each,
    rounded down and up.  Of three bits two lie in the same half of the
    fingerprint, so odd ones flip only such pairs.  Equal fingerprints are taken
    once before anything is emitted, and a variant is shared by no more
    fingerprints than a ball holds, so groups of copies make no hot key.
    Variants travel packed by bucket as (fingerprint, number of the flip); the
    number of buckets follows the count of fingerprints, so a bucket fits a task.
    A bucket's links are contracted to stars, which are written before links of
    several buckets meet, so that no task runs two Python workers.

    Every row of ``docs`` gives one row.  A null text counts as empty; empty
    texts have fingerprint zero and are linked like others; repeated rows and
    ids stay.  ``component_id`` is the smallest id of the group, null only where
    no row of the group has an id.  Other columns are not read.
    """
    prints = kept(fingerprints(docs, doc_id, text), "fingerprints")
    nodes = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    buckets = max(1, -(-nodes.count() * (SHORT + len(FLIPS)) // 2 // BUCKET))
    packed = arrow_map(nodes.select("fp"), _variants(buckets), "bucket long, prints binary, flips binary")
    links = kept(packed.groupBy("bucket").applyInArrow(_links, "a long, b long"), "bucket-links")
    roots = components(links)
    forget(links)
    group = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = group.join(group.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hexed(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of every group; rows without an id,
    which no group can name, stay.  A repeated id stays once."""
    groups = near_groups(docs)
    leaders = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_n"))
    named = docs.join(leaders, "doc_id")
    once = named.where("_n = 1").unionByName(named.where("_n > 1").dropDuplicates(["doc_id"])).select(docs.columns)
    return once.unionByName(docs.where(F.col("doc_id").isNull()))
