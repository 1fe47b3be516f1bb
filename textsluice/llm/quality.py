"""Quality scores: random Fourier features, ridge by summed normal equations,
isotonic calibration."""

from __future__ import annotations

import dataclasses
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from textsluice.llm.common import arrow_map, bytes_of, kept, sliced, small_batches

THRESHOLD = 0.3
#: Random features, width of the kernel in standard deviations, ridge penalty per row.
DIMENSIONS, WIDTH, PENALTY, SEED = 256, 4.0, 1e-3, 7
#: Partial sums of the normal equations that reach the driver, at most.
PARTIALS = 16
#: Steps that raw scores are rounded to for calibration; bounds that table.
STEPS = 2000
#: Share of the raw rank kept in a score, so that calibration makes no ties.
RANK_SHARE = 0.01

_GROUPS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9, 13), "line": (10,),
           "symbol": b"#$%&*+/<=>@[\\]^_`{}~", "bar": b"|", "shout": b"!?", "stop": b".,;:", "quote": b"\"'()-", "high": range(128, 256)}
_TO_GROUP = np.zeros((256, len(_GROUPS)))
for _k, _members in enumerate(_GROUPS.values()):
    _TO_GROUP[list(_members), _k] = 1
N_STATS = len(_GROUPS) + 11
#: Bytes counted at a time, as counting widens them.
_PART = 1 << 20


def statistics(text: bytes) -> np.ndarray:
    """Statistics of a whole text: kinds of characters, words, lines, repetition."""
    n = len(text)
    counts = sum((np.bincount(np.frombuffer(text, np.uint8, min(_PART, n - at), at), minlength=256) for at in range(0, n, _PART)),
                 np.zeros(256, np.int64))
    share = counts @ _TO_GROUP / max(n, 1)
    words, lines = text.split(), text.split(b"\n")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    distinct = Counter(words)
    p = counts[counts > 0] / max(n, 1)
    letters = share[0] + share[1]
    filled = [x for x in lines if x.strip()]
    more = [np.log1p(n), np.log1p(len(words)), lengths.mean() if len(words) else 0, lengths.std() if len(words) else 0,
            (lengths <= 3).mean() if len(words) else 0, (lengths == 1).mean() if len(words) else 0,
            len(distinct) / max(len(words), 1), max(distinct.values(), default=0) / max(len(words), 1),
            len(set(filled)) / max(len(filled), 1), -(p * np.log2(p)).sum() if n else 0, share[0] / letters if letters else 0]
    return np.concatenate([share, more])


def _stats_batch(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
    rows = [statistics(t.as_py()) for t in batch.column(1)]
    yield from sliced([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])


def remainder(doc_id: str = "doc_id") -> Column:
    """Fold of a document: checksum of its id as text, modulo 5; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)).cast("int")


@dataclasses.dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, with a constant."""
        z = np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ self.turn + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        level = np.interp(raw, self.knots, self.levels) if len(self.knots) else np.full(len(raw), 0.5)
        return (1 - RANK_SHARE) * level + RANK_SHARE / (1 + np.exp(-4 * (raw - 0.5)))


def isotonic(at: np.ndarray, total: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and means of the blocks of the best rising fit to means
    ``total / rows`` at rising points ``at``."""
    blocks: list[list[float]] = []
    for a, t, n in zip(at.tolist(), total.tolist(), rows.tolist()):
        blocks.append([a * n, t, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    b = np.array(blocks).reshape(-1, 3)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def _sums(model: Model):
    size = DIMENSIONS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist()).reshape(-1, N_STATS)
            z = model.features(x)
            total += z.T @ np.concatenate([z, batch.column(1).to_numpy()[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((DIMENSIONS + 1) * (DIMENSIONS + 2))
    for batch in batches:
        for s in batch.column(0):
            total += np.frombuffer(s.as_py())
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on documents whose id is labelled and whose fold is not 0.

    Statistics of texts are the only inputs.  Folds 2 to 4 give the ridge
    weights, whose normal equations every task sums over its own rows, and fold 1
    the calibration.  The driver sees ``PARTIALS`` partial sums and at most
    ``3 * STEPS`` calibration steps.  Null labels and labels of unknown ids count
    nothing; without any label all scores are 0.5.
    """
    rng = np.random.default_rng(SEED)
    turn, phase = rng.normal(0, 1 / WIDTH, (N_STATS, DIMENSIONS)), rng.uniform(0, 2 * np.pi, DIMENSIONS)
    marks = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("y"))
    texts = docs.select("doc_id", bytes_of("text").alias("text"))
    x = arrow_map(texts, _stats_batch, "doc_id long, x array<double>")
    rows = x.join(marks, x.doc_id == marks["_id"]).select("doc_id", "x", "y", remainder().alias("fold")).where("fold != 0")
    rows = kept(rows, "labelled")
    ridge = rows.where("fold > 1")
    sums = ridge.agg(F.count("*").alias("n"), *[f(F.col("x")[k]).alias(f"{name}{k}") for k in range(N_STATS) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not sums["n"]:
        nothing = np.zeros(0)
        return Model(np.zeros(N_STATS), np.ones(N_STATS), turn, phase, np.zeros(DIMENSIONS + 1), nothing, nothing)
    mean, scale = (np.array([sums[f"{c}{k}"] for k in range(N_STATS)], float) for c in "ms")
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), turn, phase, np.zeros(DIMENSIONS + 1), np.zeros(0), np.zeros(0))
    parts = ridge.select("x", "y").mapInArrow(_sums(model), "s binary").repartition(PARTIALS).mapInArrow(_added, "s binary").toArrow()
    total = sum(np.frombuffer(s.as_py()) for s in parts.column(0)).reshape(DIMENSIONS + 1, -1)
    penalty = np.eye(DIMENSIONS + 1) * PENALTY * sums["n"] / DIMENSIONS
    penalty[-1, -1] = 0
    model = dataclasses.replace(model, weights=np.linalg.lstsq(total[:, :-1] + penalty, total[:, -1], rcond=None)[0])

    def steps(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        raw = np.clip(model.raw(np.array(batch.column(0).to_pylist()).reshape(-1, N_STATS)), -1, 2)
        yield from sliced([np.round(raw * STEPS).astype(np.int64), batch.column(1)], ["step", "y"])

    found = (arrow_map(rows.where("fold = 1").select("x", "y"), steps, "step long, y double")
             .groupBy("step").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("step").toArrow())
    knots, levels = isotonic(*(found.column(k).to_numpy().astype(float) for k in range(3)))
    return dataclasses.replace(model, knots=knots / STEPS, levels=levels)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better) and ``predicted`` (1 from the
    threshold on) in place of columns of these names, each row where it is read.
    Null and empty texts are scored like others."""
    docs = docs.drop("score", "predicted")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        x = [statistics(t.as_py()) for t in texts]
        return pa.array(shared.value.score(np.array(x).reshape(-1, N_STATS)))

    return (docs.withColumn("score", score(bytes_of("text")))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
