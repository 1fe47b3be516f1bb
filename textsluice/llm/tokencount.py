"""Token counts from pre-token frequencies."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textsluice.llm.common import arrow_map, bytes_of, kept, sliced

#: Pre-tokens whose counts are sent to every task: so many at most, of so many
#: characters at most, which bounds what is broadcast at about 25 MB.
HEAD, HEAD_CHARS = 200_000, 64
#: Distinct pre-tokens a task counts before it passes them on.
HELD = 300_000
LIMIT = 1024


def _frequencies(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textsluice.llm.bpe import byte_bpe

        bpe, counts = byte_bpe(tokenizer), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(bpe.pieces(text))
                if len(counts) >= HELD:
                    yield from sliced([pa.array(list(counts), pa.string()), np.fromiter(counts.values(), np.int64)], ["piece", "uses"])
                    counts = Counter()
        if counts:
            yield from sliced([pa.array(list(counts), pa.string()), np.fromiter(counts.values(), np.int64)], ["piece", "uses"])
    return run


def piece_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(piece, uses, n_tokens): every distinct pre-token, tokenised once."""
    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        from textsluice.llm.bpe import byte_bpe

        bpe = byte_bpe(tokenizer)
        n = np.array([bpe.count(p) for p in batch.column(0).to_pylist()], np.int64)
        yield from sliced([batch.column(0), batch.column(1), n], ["piece", "uses", "n_tokens"])

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    seen = texts.mapInArrow(_frequencies(tokenizer), "piece string, uses long")
    return arrow_map(seen.groupBy("piece").agg(F.sum("uses").alias("uses")), count, "piece string, uses long, n_tokens long")


def _documents(tokenizer: str, head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from textsluice.llm.bpe import byte_bpe

        bpe, known = byte_bpe(tokenizer), head.value
        row = TaskContext.get().partitionId() << 40
        names = ["row", "doc_id", "n_bytes", "known", "rare", "uses"]
        for batch in batches:
            out = [[], [], [], [], [], []]
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                uses = Counter(bpe.pieces(text))
                rare = [p for p in uses if p not in known]
                total = sum(n * known[p] for p, n in uses.items() if p in known) if known else 0
                for column, value in zip(out, (row, doc, len(text.encode()), total, rare, [uses[p] for p in rare])):
                    column.append(value)
                row += 1
                size += len(rare)
                if size > 200_000:
                    yield _batch(out, names)
                    out, size = [[], [], [], [], [], []], 0
            if out[0]:
                yield _batch(out, names)
    return run


def _batch(out: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)


def _most_used(counts: DataFrame, most: int) -> DataFrame:
    """The most used pre-tokens, ``most`` at most: those above a threshold, which
    a histogram of uses gives (eight steps to a power of two), so nothing is sorted."""
    step = F.floor(F.log2("uses") * 8)
    left, least = most, None
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():     # 512 steps at most
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    return counts.where(F.lit(False) if least is None else step >= least)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    Each distinct pre-token is tokenised once.  The counts of the most frequent
    ones, a bounded number of bounded length, are joined by a broadcast table
    where documents are read; the other frequencies are joined by a shuffle on
    the pre-token, so frequent ones make no hot key there.  Ids are never kept.

    A null text counts as empty and has no tokens.  Rows with null or repeated
    ids give one row each; an empty table gives none.  Other columns are not read.
    """
    spark = docs.sparkSession
    counts = kept(piece_counts(docs, tokenizer), "pieces")
    short = counts.where(F.length("piece") <= HEAD_CHARS)
    top = _most_used(short, head).select("piece", "n_tokens").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist())))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = kept(rows.mapInArrow(_documents(tokenizer, known), "row long, doc_id long, n_bytes long, known long, rare array<string>, uses array<long>"), "frequencies")
    rare = found.select("row", F.explode(F.arrays_zip("rare", "uses")).alias("x")).select("row", F.col("x.rare").alias("piece"), F.col("x.uses").alias("n"))
    tail = rare.join(counts.select("piece", "n_tokens"), "piece").groupBy("row").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tail"))
    n = F.col("known") + F.coalesce("tail", F.lit(0))
    return (found.drop("rare", "uses").join(tail, "row", "left")
            .select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit")))
