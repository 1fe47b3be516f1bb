"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textsluice.session import ensure_checkpoint_dir

#: Rows an Arrow batch of results holds at most, so that wide results stay small.
OUT_ROWS = 50_000
#: Bytes of text a task works on at a time; a longer text is taken alone.
TEXT_BYTES = 1 << 22
#: Bytes of an Arrow batch on its way to Python, where the session sets none.
BATCH_BYTES = "4m"


def kept(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to the folder all executors share and read back.

    Lineage ends here, so a lost executor repeats reads and no earlier work, and
    a table used twice is computed once.  The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Removes the files of ``kept`` tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bytes_of(name: str) -> Column:
    """The UTF-8 bytes of a text column; none for null."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def map_in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches limited by bytes, as 10,000 texts may have any
    size.  A limit that the session already has stays."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def small_batches(spark: SparkSession) -> None:
    """Limits Arrow batches to ``BATCH_BYTES`` in a session that sets no limit."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, BATCH_BYTES)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` of a function on single batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)
    return map_in_arrow(df, run, schema)


def portions(batch: pa.RecordBatch, column: int, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of whole rows whose texts in ``column`` have at most so
    many bytes, or of one row, so that work arrays don't grow with the batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_slices(text: bytes, most: int = TEXT_BYTES) -> Iterator[bytes]:
    """A long text in slices cut at white space, so that lists of words stay short."""
    at = 0
    while len(text) - at > most and (cut := SPACE.search(text, at + most)):
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def text_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str, column: int, most: int = TEXT_BYTES) -> DataFrame:
    """``mapInArrow`` of a function on the portions of batches by the texts in ``column``."""
    return arrow_map(df, lambda batch: (out for part in portions(batch, column, most) for out in fn(part)), schema)


def sliced(arrays: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``OUT_ROWS`` rows."""
    table = pa.RecordBatch.from_arrays([a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a) for a in arrays], names=names)
    for at in range(0, table.num_rows, OUT_ROWS):
        yield table.slice(at, OUT_ROWS)


def as_bytes(batch: pa.RecordBatch) -> bytes:
    """A batch in Arrow's stream form: one binary value instead of nested columns,
    which Spark's readers and writers would unfold value by value."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def from_bytes(body) -> pa.RecordBatch:
    """The batch that :func:`as_bytes` wrote; its arrays lie in *body*."""
    return pa.ipc.open_stream(body).read_next_batch()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads nearby values over all bits."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class WordHashes(dict):
    """64-bit hashes of words; remembers a bounded number of them."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.most:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolled(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` words, in order."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[k:len(words) - n + 1 + k]
        total ^= total >> np.uint64(29)
    return mixed(total)


def bitmap(df: DataFrame, name: str, bits: int) -> np.ndarray:
    """A bitmap of the upper ``bits`` of well mixed hashes in a long column; its
    size is fixed, however many there are."""
    at = F.shiftrightunsigned(name, 64 - bits)
    words = (df.select((at / 64).cast("int").alias("w"), F.pmod(at, F.lit(64)).cast("int").alias("b"))
             .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("m")).toArrow())
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return out


def in_bitmap(seen: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes may be in the bitmap."""
    bit = hashes >> np.uint64(64 - bits)
    return (seen[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def marked(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, bits: int = 24) -> DataFrame:
    """``df`` with ``_near``: false where ``key`` is surely not in ``wanted``.

    ``wanted`` becomes a bitmap of ``2**bits`` bits in words of 64, so what is
    broadcast has at most ``2**(bits-6)`` rows whatever the size of the data.
    With many wanted keys more rows pass; an exact join must follow.
    """
    h = F.pmod(F.xxhash64(wanted_key), F.lit(1 << bits))
    words = (wanted.select(h.alias("_h"))
             .select((F.col("_h") / 64).cast("long").alias("_word"), F.pmod("_h", F.lit(64)).cast("int").alias("_bit"))
             .groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_mask")))
    p = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    return (df.withColumn("_p", p).withColumn("_word", (F.col("_p") / 64).cast("long"))
            .join(F.broadcast(words), "_word", "left")
            .withColumn("_near", F.coalesce(F.expr("(shiftright(_mask, cast(pmod(_p, 64) as int)) & 1L) = 1"), F.lit(False)))
            .drop("_p", "_word", "_mask"))
