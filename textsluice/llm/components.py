"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textsluice.llm.common import kept, sliced

#: Links contracted at a time inside a task.
LOCAL_LINKS = 1_000_000


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links and, for each, the smallest node it is connected to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        x, y = root[left], root[right]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root != root[root]).any():
            root = root[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def stars() -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
        nodes, roots = local_roots(a, b)
        out = nodes != roots
        yield from sliced([nodes[out], roots[out]], ["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= LOCAL_LINKS:
            yield from stars()
            held = []
    if held:
        yield from stars()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b: long) that is not a root.

    Tasks first contract their own links to stars; then large and small stars
    alternate until nothing changes.  Every step is a grouping with a partial
    minimum and an equi-join, so a component of any size is spread over tasks
    and nothing is gathered.  Links with a null end or equal ends count nothing.
    """
    links = links.where(F.col("a") != F.col("b")).select("a", "b").mapInArrow(_contract, "a long, b long")
    stars = kept(links.distinct(), "links")
    before = None
    while True:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20)"))).first()
        if now[0] == 0 or now == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a != b").distinct()
        floor = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (down.join(floor, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(floor.select("a", F.col("m").alias("b"))))
        stars = kept(small.distinct(), "links")
