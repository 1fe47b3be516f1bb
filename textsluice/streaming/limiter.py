"""The sliding-log limiter on an unbounded stream."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.rules import MAX_REQUESTS, WINDOW_US
from ..operators.limiter import HOT_ROWS, admit, live_stamps, order_micros, quota_key, rate_limit

_LIVE = T.StructType([T.StructField("live", T.ArrayType(T.LongType()))])


def stream_rate_limit(stream: DataFrame, *, max_requests: int = MAX_REQUESTS, window_us: int = WINDOW_US,
                      user: str = "user_id", ts: str = "ts", seq: str = "seq",
                      tenant: str | None = None, late: str | None = None) -> DataFrame:
    """Adds ``limited`` and ``retry_after`` to a stream of narrow rows.

    Arrival order is the order: micro-batches follow one another, and rows of a
    micro-batch are taken by (*ts*, *seq*).  State is the live stamps of a user,
    at most ``max_requests`` of them, in the state store.  Size micro-batches
    at the source (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``): a user's
    rows of one micro-batch meet in one task.  Where that may be too many, use
    :func:`limit_batches`.

    With *late*, how far rows may be behind the newest (such as ``"10 minutes"``),
    *ts* gets a watermark and every user an event-time timer at their last
    stamp plus the window: when the watermark passes it no stamp of theirs can
    count again and the state is dropped, which changes no verdict.  So state
    holds users of the last window, not all ever seen.  Spark drops rows that
    are later than that.
    """
    if max_requests < 1:
        raise ValueError("max_requests must be at least 1")
    if late is not None and not isinstance(stream.schema[ts].dataType, T.TimestampType):
        raise ValueError(f"a watermark needs {ts} to be a timestamp")
    names = stream.columns
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in stream.schema.fields],
                           T.StructField("limited", T.BooleanType()), T.StructField("retry_after", T.LongType())])

    # whole numbers may be null, which plain pandas would turn into floats
    whole = [f.name for f in stream.schema.fields if isinstance(f.dataType, (T.LongType, T.IntegerType))]

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        live = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["_us", "_seq"], kind="stable")
        us = rows["_us"].to_numpy(np.int64)
        limited, retry, live = admit(us, np.full(len(us), max_requests, dtype=np.int64), live, window_us)
        state.update((live,))
        if late is not None:
            state.setTimeoutTimestamp(max((max(live) + window_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        out = rows[names].astype({c: "Int64" for c in whole})
        out["limited"] = limited
        out["retry_after"] = pd.array(np.where(limited, retry, 0), dtype="Int64")
        out.loc[~limited, "retry_after"] = pd.NA
        yield out

    stream = stream if late is None else stream.withWatermark(ts, late)
    keyed = (stream.withColumn("_user", quota_key(user, tenant)).withColumn("_us", order_micros(stream, ts))
             .withColumn("_seq", F.col(seq).cast("long")))
    return keyed.groupBy("_user").applyInPandasWithState(
        step, schema, _LIVE, "append",
        GroupStateTimeout.NoTimeout if late is None else GroupStateTimeout.EventTimeTimeout)


def limit_batches(stream: DataFrame, path: str, checkpoint: str, *, max_requests: int = MAX_REQUESTS,
                  window_us: int = WINDOW_US, user: str = "user_id", ts: str = "ts", seq: str = "seq",
                  tenant: str | None = None, hot_rows: int = HOT_ROWS, late_us: int | None = None, **trigger):
    """Runs the batch limiter on every micro-batch and starts the query.

    For streams in which one user may send much of a micro-batch: rows are
    sorted by Spark and hot users are cut into chunks.  Decisions are written
    to ``path/data/batch=N`` and the stamps alive afterwards to
    ``path/state/batch=N``, so a repeated batch starts from the same state and
    replaces its own files; state folders that no batch can start from any more
    are removed.  *path* must be a folder all executors share.  With *late_us*
    rows must not be further than that behind the newest seen: stamps that no
    such row can meet are dropped, so state holds the users of the last window.
    """
    def step(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        before = None
        if batch_id > 0:
            before = spark.read.schema("quota_key string, us long").parquet(f"{path}/state/batch={batch_id - 1}")
        decided = rate_limit(batch, max_requests=max_requests, window_us=window_us, user=user, ts=ts, seq=seq,
                             tenant=tenant, hot_rows=hot_rows, carried=before)
        decided.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")
        written = spark.read.schema(decided.schema).parquet(f"{path}/data/batch={batch_id}")
        used = written.where(~F.col("limited")).select(quota_key(user, tenant).alias("quota_key"), order_micros(written, ts).alias("us"))
        live_stamps(used, before, window_us, late_us).write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state/batch={batch_id - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return (stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
