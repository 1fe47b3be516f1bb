"""Streams give the batch results, also over several micro-batches."""

import pytest
from pyspark.sql import functions as F

from textsluice.operators.config import Config
from textsluice.operators.gate import gate
from textsluice.operators.limiter import rate_limit
from textsluice.plans import catalog as c
from textsluice.streaming.gate import (read_committed, read_rollup, second_table, stream_gate, stream_rollup, write_rollup,
                                       write_with_handler)
from textsluice.streaming.limiter import limit_batches, stream_rate_limit

DAY = 86_400_000_000


@pytest.fixture(scope="module")
def slices(spark, sf, tmp_path_factory):
    """The requests as four files in time order, read one per micro-batch."""
    path = str(tmp_path_factory.mktemp("requests"))
    reqs = c.requests(spark, sf)
    edges = [r[0] for r in reqs.select(F.percentile_approx("ts", [0.25, 0.5, 0.75]).alias("q")).select(F.explode("q")).collect()]
    for low, high in zip([None, *edges], [*edges, None]):
        part = reqs
        part = part if low is None else part.where(F.col("ts") > low)
        part = part if high is None else part.where(F.col("ts") <= high)
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, slices, build, out):
    source = spark.readStream.schema("seq long, ts timestamp, user_id string, text string").option(
        "maxFilesPerTrigger", 1).parquet(slices)
    stream = build(source)
    (stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def test_stream_limiter_is_batch(spark, slices, sf, tmp_path):
    got = run(spark, slices, lambda s: stream_rate_limit(s.drop("text"), max_requests=2, window_us=DAY), tmp_path)
    want = rate_limit(c.requests(spark, sf).drop("text"), max_requests=2, window_us=DAY)
    cols = ["seq", "limited", "retry_after"]
    assert {tuple(r) for r in got.select(cols).collect()} == {tuple(r) for r in want.select(cols).collect()}
    assert got.where("limited").count() > 0


def test_stream_gate_is_batch(spark, slices, sf, tmp_path):
    config = Config(max_requests_per_minute=2, enable_policy_enforcement=False)
    got = run(spark, slices, lambda s: stream_gate(s, config, window_us=DAY), tmp_path)
    want = gate(c.requests(spark, sf), config, window_us=DAY)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_handler_gets_every_batch(spark, slices, tmp_path):
    seen = []
    stream = spark.readStream.schema("seq long, ts timestamp, user_id string, text string").option(
        "maxFilesPerTrigger", 2).parquet(slices)
    write_with_handler(stream, f"{tmp_path}/out", lambda df, i: seen.append(df.count()), f"{tmp_path}/cp").awaitTermination()
    assert sum(seen) == spark.read.parquet(slices).count() and len(seen) >= 2


@pytest.mark.parametrize("hot_rows", [10**9, 60])
def test_limited_batches_are_batch(spark, slices, sf, tmp_path, hot_rows):
    """A third of the rows share one key; state is carried between batches."""
    def shared(df):
        return df.drop("text").withColumn("user_id", F.when(F.col("seq") % 3 > 0, F.col("user_id")))

    source = shared(spark.readStream.schema("seq long, ts timestamp, user_id string, text string").option(
        "maxFilesPerTrigger", 2).parquet(slices))
    limit_batches(source, f"{tmp_path}/out", f"{tmp_path}/cp", max_requests=3, window_us=DAY, hot_rows=hot_rows).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/data")
    want = rate_limit(shared(c.requests(spark, sf)), max_requests=3, window_us=DAY)
    cols = ["seq", "limited", "retry_after"]
    assert {tuple(r) for r in got.select(cols).collect()} == {tuple(r) for r in want.select(cols).collect()}
    assert got.where("limited").count() > 100


HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def bursts(spark, tmp_path_factory):
    """Three files: two days of many users, then a row a year later, and one a day after that."""
    path = str(tmp_path_factory.mktemp("bursts"))
    start = 86_400_000
    rows = [[(i, i * 200, f"u{i % 17}") for i in range(400)], [(1000 + i, 86_000 + i * 200, f"u{i % 13}") for i in range(300)],
            [(5000, 31_536_000, "late")], [(5001, 31_622_400, "last")]]
    for part in rows:
        (spark.createDataFrame(part, "seq long, at long, user_id string").select("seq", F.timestamp_seconds(F.col("at") + start).alias("ts"), "user_id")
         .coalesce(1).write.mode("append").parquet(path))
    return path


def test_state_leaves_by_event_time(spark, bursts, tmp_path):
    source = spark.readStream.schema("seq long, ts timestamp, user_id string").option("maxFilesPerTrigger", 1).parquet(bursts)
    out = f"{tmp_path}/out"
    query = (stream_rate_limit(source, max_requests=1, window_us=HOUR, late="2 hours").writeStream.format("parquet").option("path", f"{out}/data")
             .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    got = spark.read.parquet(f"{out}/data")
    want = rate_limit(spark.read.parquet(bursts), max_requests=1, window_us=HOUR)
    cols = ["seq", "limited", "retry_after"]
    assert {tuple(r) for r in got.select(cols).collect()} == {tuple(r) for r in want.select(cols).collect()} and got.where("limited").count() > 50
    held = spark.read.format("statestore").load(f"{out}/state").count()
    assert held <= 2        # seventeen users came; those older than the last watermark have left
    with pytest.raises(ValueError):
        stream_rate_limit(source.withColumn("ts", F.unix_micros("ts")), late="1 hour")


def test_batches_drop_expired_stamps_and_old_folders(spark, bursts, tmp_path):
    source = spark.readStream.schema("seq long, ts timestamp, user_id string").option("maxFilesPerTrigger", 1).parquet(bursts)
    limit_batches(source, f"{tmp_path}/out", f"{tmp_path}/cp", max_requests=3, window_us=HOUR, late_us=2 * HOUR).awaitTermination()
    want = rate_limit(spark.read.parquet(bursts), max_requests=3, window_us=HOUR)
    cols = ["seq", "limited", "retry_after"]
    got = spark.read.parquet(f"{tmp_path}/out/data")
    assert {tuple(r) for r in got.select(cols).collect()} == {tuple(r) for r in want.select(cols).collect()}
    assert sorted(p.name for p in (tmp_path / "out" / "state").iterdir()) == ["batch=2", "batch=3"]
    assert [r.quota_key for r in spark.read.parquet(f"{tmp_path}/out/state/batch=3").collect()] == ["last"]


def test_roll_up_writes_changed_windows(spark, bursts, tmp_path):
    source = spark.readStream.schema("seq long, ts timestamp, user_id string").option("maxFilesPerTrigger", 1).parquet(bursts)
    typed = source.withColumn("event_type", F.when(F.col("seq") % 3 == 0, "INPUT_BLOCKED").otherwise("INPUT_PROCESSED"))
    write_rollup(stream_rollup(typed, "event_type", late="1 day"), f"{tmp_path}/data", f"{tmp_path}/cp").awaitTermination()
    got = {(r.window_start, r.event_type, r.events, r.blocked) for r in read_rollup(spark, f"{tmp_path}/data", "event_type").collect()}
    from textsluice.operators.audit import rollup

    whole = spark.read.parquet(bursts).withColumn("event_type", F.when(F.col("seq") % 3 == 0, "INPUT_BLOCKED").otherwise("INPUT_PROCESSED"))
    assert got == {(r.window_start, r.event_type, r.events, r.blocked) for r in rollup(whole, "event_type").collect()}
    last = spark.read.parquet(f"{tmp_path}/data").groupBy("batch").count().orderBy("batch").collect()
    assert last[-1]["count"] <= 1       # old windows are not written again


def test_failed_handler_is_repeated(spark, bursts, tmp_path):
    """The handler fails once on the second batch: nothing of that batch is
    seen, and after a new start every row stands in both tables once."""
    seen, log, alerts = [], f"{tmp_path}/log", f"{tmp_path}/alerts"
    write = second_table(alerts, lambda df: df.where("seq % 2 = 0"))

    def handler(df, batch_id):
        seen.append(batch_id)
        write(df, batch_id)
        if seen.count(1) == 1 and batch_id == 1:
            raise RuntimeError("down")

    def start():
        source = spark.readStream.schema("seq long, ts timestamp, user_id string").option("maxFilesPerTrigger", 1).parquet(bursts)
        return write_with_handler(source, log, handler, f"{tmp_path}/cp")

    with pytest.raises(Exception, match="down"):
        start().awaitTermination()
    assert read_committed(spark, log).count() == 400 and read_committed(spark, alerts, log).count() == 200
    assert spark.read.parquet(f"{log}/data").count() == 700         # written, not committed
    start().awaitTermination()
    assert seen.count(1) == 2
    rows = sorted(r.seq for r in spark.read.parquet(bursts).collect())
    assert sorted(r.seq for r in read_committed(spark, log).collect()) == rows
    assert sorted(r.seq for r in read_committed(spark, alerts, log).collect()) == [s for s in rows if s % 2 == 0]
