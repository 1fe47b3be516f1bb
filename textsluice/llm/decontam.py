"""Benchmark passages in documents, by spaced seeds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textsluice.llm.common import WordHashes, arrow_map, bitmap, bytes_of, in_bitmap, kept, map_in_arrow, mixed, portions, sliced

#: Words of an overlap; shorter items are compared whole.
OVERLAP = 13
#: Share of an overlap's words that must be equal.
SHARE = 0.8
#: Words a seed spans, and the masks: 1 where a word counts, 0 where any word will do.
SPAN = 8
MASKS = ("11011101", "10100111", "11110100", "00111011")
#: Words beside a seed within which an overlap around it lies.
BESIDE = OVERLAP - SPAN
#: Bits of the map of test seeds that spares most training seeds the shuffle.
MAP_BITS = 25


def needed(words: int) -> int:
    """Equal words that an overlap of so many words needs."""
    return -(-words * round(SHARE * 100) // 100)


def _shapes() -> list[tuple[int, list[int]]]:
    """(span, positions that count): the masks, and whole items shorter than a mask."""
    return [(n, list(range(n))) for n in range(1, SPAN)] + [(SPAN, [i for i, c in enumerate(m) if c == "1"]) for m in MASKS]


def _seeds(h: np.ndarray, shape: int, span: int, count: list[int]) -> np.ndarray:
    out = np.full(max(0, len(h) - span + 1), np.uint64(shape + 1))
    for p in count:
        out = (out ^ h[p:len(h) - span + 1 + p]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return mixed(out)


def _around(h: np.ndarray, at: np.ndarray) -> pa.Array:
    """Words from ``BESIDE`` before to ``BESIDE`` after a seed of full span."""
    wide = SPAN + 2 * BESIDE
    values = h[at[:, None] + np.arange(-BESIDE, wide - BESIDE)[None, :]].view(np.int64).ravel()
    return pa.ListArray.from_arrays(np.arange(0, len(values) + 1, wide, dtype=np.int32), pa.array(values))


def _hashed(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Word hashes of all texts in one array with zeros between, where each text
    begins in it, and the texts' words."""
    gap = np.zeros(OVERLAP, np.uint64)
    parts, begins, counts, at = [gap], [], [], OVERLAP
    for text in texts:
        words = text.lower().split()
        begins.append(at)
        counts.append(len(words))
        parts += [hashes.of(words) | np.uint64(1), gap]     # never zero
        at += len(words) + OVERLAP
    return np.concatenate([*parts, gap]), np.array(begins, np.int64), counts


def _item_seeds(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
    h, begins, counts = _hashed(batch.column(1).to_pylist(), WordHashes())
    ids = batch.column(0).to_pylist()
    for shape, (span, count) in enumerate(_shapes()):
        seeds = _seeds(h, shape, span, count)
        at = [np.arange(b, b + n - span + 1) if n == span or span == SPAN <= n else np.zeros(0, np.int64) for b, n in zip(begins, counts)]
        who = np.repeat(np.arange(len(at)), [len(a) for a in at])
        at = np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64)
        if len(at):
            yield from sliced([seeds[at].view(np.int64), pa.array([ids[i] for i in who], pa.int64()), np.array(counts, np.int64)[who], _around(h, at)],
                              ["seed", "item_id", "words", "item_words"])


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """(seed, item_id, words, item_words) of every seed of every test item."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), bytes_of("text").alias("text"))
    return arrow_map(rows, _item_seeds, "seed long, item_id long, words long, item_words array<long>").dropDuplicates(["seed", "item_id", "item_words"])


def _document_seeds(shared, shapes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, hashes, every = shared.value, WordHashes(), _shapes()
        for batch in (part for batch in batches for part in portions(batch, 1)):
            h, begins, counts = _hashed(batch.column(1).to_pylist(), hashes)
            ids = batch.column(0)
            for shape in shapes:
                span, count = every[shape]
                seeds = _seeds(h, shape, span, count)
                at = np.flatnonzero(in_bitmap(seen, seeds, MAP_BITS))
                who = np.searchsorted(begins, at, side="right") - 1
                fit = (who >= 0) & (at + span <= (begins + np.array(counts))[who])
                at, who = at[fit], who[fit]
                if len(at):
                    yield from sliced([seeds[at].view(np.int64), ids.take(pa.array(who)), _around(h, at)], ["seed", "doc_id", "doc_words"])
    return run


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched): documents that hold words of a test item.

    A document overlaps an item if ``OVERLAP`` words of it, in place, equal words
    of the item but for a fifth of them (items shorter than that: the whole item;
    shorter than a seed: all words).  Case and kind of white space don't count.
    Whatever words are replaced, some mask finds a seed in such an overlap.

    Seeds of documents are checked against a bitmap of fixed size where they are
    read; what passes is joined with the items' seeds by a shuffle and compared
    word by word around the hit.  ``matched`` is the most equal words around one
    hit.  Items without words, null texts, null ids and empty tables overlap
    nothing; repeated rows and items show once.
    """
    items = kept(item_seeds(benchmark.where(F.col("item_id").isNotNull())), "item-seeds")
    lengths = {r[0] for r in items.select(F.least("words", F.lit(SPAN))).distinct().collect()}    # at most SPAN rows
    shapes = [k for k, (span, _) in enumerate(_shapes()) if span in lengths]
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(items, "seed", MAP_BITS))
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), bytes_of("text").alias("text"))
    found = map_in_arrow(rows, _document_seeds(shared, shapes), "seed long, doc_id long, doc_words array<long>")
    equal = found.join(items, "seed").select("doc_id", "item_id", "words", F.zip_with(
        "doc_words", "item_words", lambda a, b: F.when((a == b) & (a != 0), 1).otherwise(0)).alias("eq"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    best = F.when(F.col("words") < SPAN, total(F.slice("eq", BESIDE + 1, F.col("words").cast("int")))).when(F.col("words") < OVERLAP, total("eq")).otherwise(
        F.array_max(F.transform(F.sequence(F.lit(1), F.lit(BESIDE + 1)), lambda i: total(F.slice("eq", i, OVERLAP)))))
    need = F.when(F.col("words") < SPAN, F.col("words")).otherwise(F.ceil(F.least("words", F.lit(OVERLAP)) * round(SHARE * 100) / 100))
    return (equal.select("doc_id", "item_id", best.cast("long").alias("matched"), need.alias("need")).where("matched >= need")
            .groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that overlap no test item, with all their columns."""
    return docs.join(overlaps(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
