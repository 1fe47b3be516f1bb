"""The request gate and the audit roll-up on streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.rules import POLICIES, WINDOW_US, Policy
from ..operators import audit
from ..operators.config import Config
from ..operators.gate import VERDICT, policy_counts, screen_requests, settings_of, verdict_columns
from .limiter import stream_rate_limit


def stream_gate(requests: DataFrame, config: Config = Config(), policies: Sequence[Policy] = POLICIES, *,
                window_us: int = WINDOW_US, tenant: str | None = None, late: str | None = None) -> DataFrame:
    """Verdicts for a stream of requests (seq, ts, user_id, text): a stateless
    projection of the texts, then the stateful limiter on narrow rows.  With
    *late* users idle for a window leave the state (see ``stream_rate_limit``)."""
    screened = screen_requests(requests, config, policies).select(
        "seq", "ts", "user_id", *([tenant] if tenant else []), "n_bytes", "input_mask", "policy_masks")
    if config.enable_rate_limiting:
        limited = stream_rate_limit(screened, max_requests=config.max_requests_per_minute, window_us=window_us, tenant=tenant, late=late)
    else:
        limited = screened.withColumn("limited", F.lit(False)).withColumn("retry_after", F.lit(None).cast("bigint"))
    return verdict_columns(limited, settings_of(config), policy_counts(policies)).select(*VERDICT)


def stream_rollup(events: DataFrame, *by: str, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Audit counts per window on a stream; state is dropped and rows emitted
    once the watermark passes a window."""
    return audit.rollup(events.withWatermark("ts", late), *by, every=every)


def write_rollup(rolled: DataFrame, path: str, checkpoint: str, **trigger):
    """Writes a windowed roll-up in update mode: each micro-batch appends only
    the windows it changed, under its own number, so a repeated batch replaces
    its files and no finished window is written again."""
    def step(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (rolled.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_rollup(spark: SparkSession, path: str, *by: str) -> DataFrame:
    """The newest state of every window and *by* group of a written roll-up."""
    newest = W.partitionBy("window_start", *by).orderBy(F.desc("batch"))
    rows = spark.read.parquet(path)
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "batch")


Handler = Callable[[DataFrame, int], None]


def write_with_handler(stream: DataFrame, path: str, handler: Handler, checkpoint: str, **trigger):
    """Appends a stream to ``path/data`` and hands every micro-batch to *handler*
    (DataFrame, batch id) as well, such as :func:`second_table`.

    A batch counts once its number is in ``path/commits``, which is written
    last: files are named by batch, so a batch that failed on the way, in the
    handler too, is run again and replaces what it left.  The handler must do
    the same with its batch id.  Read both with :func:`read_committed`.
    """
    def both(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")
        handler(spark.read.schema(batch.schema).parquet(f"{path}/data/batch={batch_id}"), batch_id)
        spark.range(1).select(F.lit(1).alias("done")).write.mode("overwrite").parquet(f"{path}/commits/batch={batch_id}")

    return (stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def second_table(path: str, made: Callable[[DataFrame], DataFrame]) -> Handler:
    """A handler that keeps what *made* makes of each batch in ``path/data``."""
    def handler(batch: DataFrame, batch_id: int) -> None:
        made(batch).write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")
    return handler


def read_committed(spark: SparkSession, path: str, commits: str | None = None) -> DataFrame:
    """The rows of finished batches.  *commits* is the path of the table whose
    stream wrote this one as its second; both then show the same batches."""
    done = spark.read.parquet(f"{commits or path}/commits").select("batch")
    return spark.read.parquet(f"{path}/data").join(done, "batch", "left_semi").drop("batch")
