"""Token ids in binary files: Simple-8b words with escapes and block offsets.

A 64-bit word has a selector in its upper 4 bits.  Selectors 0 to 13 pack as
many ids as ``COUNTS`` says into the lower 60 bits, the first id lowest;
selector 14 is a run of one id (28 bits of length above 32 bits of id);
selector 15 is an escape: the lower bits number a raw 64-bit id in the file's
list of escapes.  Every block of ``BLOCK`` ids starts a new word, and the file
has the word that each block starts at, so any id is found without decoding
what is before its block, and a block decodes as arrays, selector by selector.

A file is a header, then per document its id, whether it has one, and where its
ids end; then block offsets, escapes and words.  All numbers are little-endian
and 8 bytes wide.  A line end closes the file.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from textsluice.llm.common import kept, map_in_arrow, portions

MAGIC = b"S8BTOKEN"
FIELDS = ("version", "part", "number", "docs", "ids", "blocks", "words", "escapes")
#: Ids of a block, which a reader decodes at once.
BLOCK = 4096
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = 60 // COUNTS
RUN, ESCAPE = 14, 15
LONGEST_RUN = (1 << 28) - 1
#: Ids that the coder works on at a time.
STEP = 64 * BLOCK
#: Ids after which a file is closed (some 20 MB); a document is never cut.
FILE_IDS = 1 << 23
#: Bytes of text a part is meant to hold, and the most parts there are.
PART_BYTES, MOST_PARTS = 1 << 25, 20_000
END = 2


#: Bits that each number of 16 bits needs.
BITS = np.concatenate([[0], np.repeat(np.arange(1, 17), 1 << np.arange(16))]).astype(np.uint8)
#: Ids that a word of each selector takes; a run's length is its own.
TAKES = np.append(COUNTS, [0, 1])


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs."""
    if not len(ids) or int(ids.max()) < 1 << 16:
        return BITS[ids.astype(np.uint16)]
    out = np.zeros(len(ids), np.uint8)
    for k in range(4):
        part = BITS[(ids >> np.uint64(16 * k)).astype(np.uint16)]
        out = np.where(part > 0, part + np.uint8(16 * k), out)
    return out


def _fullest(bits: np.ndarray, block: int) -> np.ndarray:
    """The selector of the fullest word that could start at each id and stay in
    its block."""
    n, gap = len(bits), int(COUNTS[0])
    blocks = -(-n // block)
    padded = np.full((blocks, block + gap), 255, np.uint8)      # no word reaches over a block's end
    whole = n // block
    padded[:whole, :block] = bits[:whole * block].reshape(whole, block)
    if whole < blocks:
        padded[whole, :n - whole * block] = bits[whole * block:]
    widest = padded.ravel()
    selector, window = np.full(len(widest), ESCAPE, np.uint8), 1
    for k in range(len(COUNTS) - 1, -1, -1):        # maxima of ever longer windows; the last that fits wins
        while window < COUNTS[k]:
            step = min(window, int(COUNTS[k]) - window)
            longer = widest.copy()
            np.maximum(widest[:-step], widest[step:], out=longer[:-step])
            widest, window = longer, window + step
        np.putmask(selector, widest <= WIDTHS[k], np.uint8(k))
    return selector.reshape(blocks, block + gap)[:, :block].ravel()[:n]


def encoded(ids: np.ndarray, block: int = BLOCK, escaped: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word that each block starts at, escapes) of unsigned 64-bit ids.

    Words are chosen from left to right: a run if it takes more ids than the
    fullest other word.
    """
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.arange(0, n, block)
    bits = _bits(ids)
    selector = _fullest(bits, block)
    takes = TAKES[selector]
    # runs are cut at block ends, so those of a block are looked at alone
    same = np.zeros(n + 1, np.int8)
    same[1:n] = ids[1:] == ids[:-1]
    same[starts] = 0
    turn = np.diff(same)
    begin, stop = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) + 1
    fits = bits[begin] <= 32
    begin, size = begin[fits], (stop - begin)[fits]
    within = _within(size)
    at, left = np.repeat(begin, size) + within, np.minimum(np.repeat(size, size) - within, LONGEST_RUN)
    better = left > takes[at]
    selector[at[better]], takes[at[better]] = RUN, left[better]
    step, at, chain = np.where(takes < 256, takes, 0).astype(np.uint8).tobytes(), 0, []
    while at < n:
        chain.append(at)
        at += step[at] or int(takes[at])
    first = np.array(chain, np.int64)
    kind = selector[first]
    words = kind.astype(np.uint64) << np.uint64(60)
    for k, (count, width) in enumerate(zip(COUNTS.tolist(), WIDTHS.tolist())):
        of = np.flatnonzero(kind == k)
        for j in range(count if len(of) else 0):
            words[of] |= ids[first[of] + j] << np.uint64(j * width)
    of = np.flatnonzero(kind == RUN)
    words[of] |= takes[first[of]].astype(np.uint64) << np.uint64(32) | ids[first[of]]
    of = np.flatnonzero(kind == ESCAPE)
    words[of] |= np.arange(escaped, escaped + len(of), dtype=np.uint64)
    return words, np.searchsorted(first, starts), ids[first[of]]


def decoded(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of whole blocks of words, as unsigned 64-bit numbers."""
    kind = (words >> np.uint64(60)).astype(np.int64)
    low = words & np.uint64((1 << 60) - 1)
    takes = np.append(COUNTS, [1, 1])[kind]
    runs = np.flatnonzero(kind == RUN)
    takes[runs] = (low[runs] >> np.uint64(32)).astype(np.int64)
    start = np.cumsum(takes) - takes
    out = np.zeros(int(takes.sum()), np.uint64)
    for k, (count, width) in enumerate(zip(COUNTS.tolist(), WIDTHS.tolist())):
        of = np.flatnonzero(kind == k)
        mask = np.uint64((1 << width) - 1)
        for j in range(count if len(of) else 0):
            out[start[of] + j] = low[of] >> np.uint64(j * width) & mask
    if len(runs):
        where = np.repeat(start[runs], takes[runs]) + _within(takes[runs])
        out[where] = np.repeat(low[runs] & np.uint64(0xFFFFFFFF), takes[runs])
    of = np.flatnonzero(kind == ESCAPE)
    out[start[of]] = escapes[low[of].astype(np.int64)]
    return out


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. counts[0] - 1, 0, 1, .. counts[1] - 1, and so on."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


class Writer:
    """Collects documents for one file; ids are coded as they come."""

    def __init__(self):
        self.doc_ids, self.ends, self.n = [], [], 0
        self.held: list[np.ndarray] = []
        self.held_ids, self.n_words = 0, 0
        self.words, self.offsets, self.escapes = [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.n += len(ids)
        self.doc_ids.append(doc_id)
        self.ends.append(self.n)
        self.held.append(ids)
        self.held_ids += len(ids)
        if self.held_ids >= STEP:
            self._code(self.held_ids // BLOCK * BLOCK)

    def _code(self, n: int) -> None:
        ids = np.concatenate(self.held)
        for at in range(0, n, STEP):
            words, offsets, escapes = encoded(ids[at:min(n, at + STEP)], escaped=sum(map(len, self.escapes)))
            self.words.append(words)
            self.offsets.append(offsets + self.n_words)
            self.escapes.append(escapes)
            self.n_words += len(words)
        self.held, self.held_ids = [ids[n:].copy()], len(ids) - n

    def body(self, part: int, number: int) -> bytes:
        if self.held_ids:
            self._code(self.held_ids)
        offsets, escapes, words = (np.concatenate([*x, np.zeros(0, t)]).astype(t) for x, t in (
            (self.offsets, "<u8"), (self.escapes, "<u8"), (self.words, "<u8")))
        known = np.array([d is not None for d in self.doc_ids], "<u8")
        head = np.array([1, part, number, len(self.ends), self.n, len(offsets), len(words), len(escapes)], "<u8")
        return b"".join([MAGIC, head.tobytes(), np.array([d or 0 for d in self.doc_ids], "<i8").tobytes(), known.tobytes(),
                         np.array(self.ends, "<u8").tobytes(), offsets.tobytes(), escapes.tobytes(), words.tobytes()])


class Reader:
    """One file's bytes: documents, and ids from any place."""

    def __init__(self, body: bytes):
        if body[:8] != MAGIC:
            raise ValueError("not a token id file")
        head = dict(zip(FIELDS, np.frombuffer(body, "<u8", len(FIELDS), 8).tolist()))
        if head["version"] != 1:
            raise ValueError(f"unknown version {head['version']} of a token id file")
        self.part, self.number, self.n = head["part"], head["number"], head["ids"]
        at = 8 + 8 * len(FIELDS)
        sections = []
        for count, kind in ((head["docs"], "<i8"), (head["docs"], "<u8"), (head["docs"], "<u8"), (head["blocks"], "<u8"),
                            (head["escapes"], "<u8"), (head["words"], "<u8")):
            sections.append(np.frombuffer(body, kind, count, at))
            at += 8 * count
        if body[at:] != b"\n":
            raise ValueError("a token id file is cut short")
        self.doc_ids, known, ends, self.offsets, self.escapes, self.words = sections
        self.known, self.ends = known.astype(bool), ends.astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop; only the blocks they lie in are decoded."""
        if start >= stop:
            return np.zeros(0, np.uint64)
        first, last = start // BLOCK, (stop - 1) // BLOCK + 1
        upto = int(self.offsets[last]) if last < len(self.offsets) else len(self.words)
        found = decoded(self.words[int(self.offsets[first]):upto], self.escapes)
        return found[start - first * BLOCK:stop - first * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of each document, decoded a run of blocks at a time."""
        at, doc = 0, 0
        while doc < len(self.ends):
            last = max(doc + 1, int(np.searchsorted(self.ends, at + STEP, side="right")))
            stop = int(self.ends[last - 1])
            found = self.ids(at, stop)
            start = at
            for k in range(doc, last):
                end = int(self.ends[k])
                yield (int(self.doc_ids[k]) if self.known[k] else None), start, found[start - at:end - at]
                start = end
            at, doc = stop, last


def _files(tokenizer: str, end: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from textsluice.llm.bpe import byte_bpe

        bpe, part, number, file = byte_bpe(tokenizer), TaskContext.get().partitionId(), 0, Writer()
        last = np.array([end], "<u4").tobytes()
        for batch in (p for batch in batches for p in portions(batch, 1)):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file.add(doc, np.frombuffer(bpe.ids(text) + last, "<u4"))
                if file.n >= file_ids:
                    yield pa.RecordBatch.from_arrays([pa.array([file.body(part, number)], pa.binary())], names=["body"])
                    number, file = number + 1, Writer()
        if file.n:
            yield pa.RecordBatch.from_arrays([pa.array([file.body(part, number)], pa.binary())], names=["body"])
    return run


def write_ids(docs: DataFrame, tokenizer: str, path: str, end: int = END, part_bytes: int = PART_BYTES, file_ids: int = FILE_IDS) -> None:
    """Writes the ids of every text, each with ``end`` after it, in ascending
    order of doc_id to files under ``path``.

    Documents are dealt out by ranges of (doc_id, text), in parts of about
    ``part_bytes`` of text; copies of one row spread by their place.  Spark's own
    writer commits the files, so a lost or repeated task leaves none behind.
    A null text is empty; rows without an id come first; rows with equal ids are
    ordered by a hash of the text.  An empty table gives no files.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = min(MOST_PARTS, max(1, math.ceil(size / part_bytes)))
    ordered = (rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
               .repartitionByRange(parts, "doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text"))
    files = map_in_arrow(ordered, _files(tokenizer, end, file_ids), "body binary")
    files.select(F.col("body").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").option("compression", "none").text(path)


def _documents(with_ids: bool):
    names = ["part", "number", "at", "doc_id", "first", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                file = Reader(body.as_buffer().to_pybytes())
                rows, size = [], 0
                for at, (doc, start, ids) in enumerate(file.documents()):
                    small = ids.astype("<u4")
                    if (small != ids).any():
                        raise ValueError("an id of over 32 bits has no 32-bit checksum")
                    rows.append((file.part, file.number, at, doc, start, len(ids), zlib.crc32(small.tobytes()), ids.astype(np.int64) if with_ids else None))
                    size += len(ids) * with_ids + 8
                    if size >= 1 << 20:
                        yield _batch(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names)
    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k, _ in zip(zip(*rows), kinds, names)], names=names)


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(part, number, at, doc_id, first, n_tokens, ids_crc32) of every document
    in the files: part and number of the file, place in it, ids before it there.
    ``with_ids`` adds the ids."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    schema = "part long, number long, at long, doc_id long, first long, n_tokens long, ids_crc32 long"
    return map_in_arrow(files, _documents(with_ids), schema + ", ids array<bigint>" * with_ids)


def with_starts(found: DataFrame) -> DataFrame:
    """Adds ``start``: ids of all documents before.  Files are summed inside
    parts, and parts, of which there are a bounded number, one after the other."""
    files = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    upto = W.partitionBy("part").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = files.withColumn("inside", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(parts, "part").select(
        "part", "number", (F.col("base") + F.col("inside")).alias("base"))
    return found.join(bases, ["part", "number"]).withColumn("start", F.col("base") + F.col("first")).drop("base")


def round_trip(docs: DataFrame, tokenizer: str, path: str, end: int = END) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from files written and read again."""
    write_ids(docs, tokenizer, path, end)
    found = kept(read_documents(docs.sparkSession, path), "token-documents")
    return with_starts(found).select("doc_id", "start", "n_tokens", "ids_crc32")
