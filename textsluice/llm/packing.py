"""Cost-balanced packing of documents into sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textsluice.llm.common import map_in_arrow, portions, sliced

CAPACITY, END = 2048, 1
#: Tokens packed together; bounds a task's memory and the padding, which is
#: less than one sequence per block.
BLOCK_TOKENS = 1 << 21
#: Cost of a piece of n tokens: n times the first plus n * n times the second.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def cost(length):
    """Linear work plus attention, which grows with the square of a piece."""
    return LINEAR * length + QUADRATIC * length * length


def balanced(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths.

    Long documents are cut at the capacity.  What is left goes, longest first,
    to the cheapest sequence that still has room; what fits whole nowhere is cut
    over the cheapest sequences with room.  As few sequences are opened as the
    tokens need, so only the last tokens of a block are padded.
    """
    out, rest = [], []
    sequence = 0
    for doc, length in enumerate(lengths.tolist()):
        full = length // capacity
        for k in range(full):
            out.append((doc, k * capacity, capacity, sequence, 0))
            sequence += 1
        if length % capacity:
            rest.append((length % capacity, doc, full * capacity))
    opened = -(-sum(r[0] for r in rest) // capacity)
    used, costs = np.zeros(opened, np.int64), np.zeros(opened)
    for length, doc, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        while length:
            free = capacity - used
            whole = free >= length
            at = int(np.argmin(np.where(whole if whole.any() else free > 0, costs, np.inf)))
            piece = min(length, int(free[at]))
            out.append((doc, start, piece, sequence + at, int(used[at])))
            used[at] += piece
            costs[at] += cost(piece)
            start, length = start + piece, length - piece
    return out


def _packer(tokenizer: str, capacity: int, block_tokens: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyspark import TaskContext

        from textsluice.llm.bpe import byte_bpe

        bpe = byte_bpe(tokenizer)
        end = np.array([END], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        docs, ids, held = [], [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal first, docs, ids, held
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            pieces = balanced(lengths, capacity)
            cut = [ids[d][4 * s:4 * (s + n)] for d, s, n, _, _ in pieces]
            d, s, n, q, o = np.array(pieces, np.int64).reshape(-1, 5).T
            columns = [pa.array([docs[i] for i in d], pa.int64()), s, n, np.array([zlib.crc32(x) for x in cut], np.int64),
                       lengths[d], q + first, o] + [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cut], pa.list_(pa.int32()))] * with_ids
            first += int(q.max()) + 1 if len(q) else 0
            docs, ids, held = [], [], 0
            yield from sliced(columns, names)

        for batch in (part for batch in batches for part in portions(batch, 1)):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(doc)
                ids.append(bpe.ids(text) + end)
                held += len(ids[-1]) // 4
                if held >= block_tokens:
                    yield from packed()
        if docs:
            yield from packed()
    return run


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece.

    Documents are packed where they are read, a block of tokens at a time, so
    nothing is shuffled.  A sequence's number holds its task's number, so
    numbers are unique; they have gaps.  A null or empty text is its end token
    alone.  Rows with null or repeated ids are packed as they are; an empty table
    gives no rows.  ``with_ids`` adds the ids of each piece.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_in_arrow(rows, _packer(tokenizer, capacity, block_tokens, with_ids), schema + ", ids array<int>" * with_ids)
