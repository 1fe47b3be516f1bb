"""Writing verdicts and audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.rules import AUDIT_RETENTION
from ..operators.audit import COLUMNS, retained


def verdict_json(allowed: str = "allowed") -> Column:
    """A detailed verdict as JSON: ``reason`` and ``code`` are left out of
    allowed ones, ``validation`` and ``policy`` are written as null when the
    stage was not reached."""
    keep_nulls = {"ignoreNullFields": "false"}
    ends = [F.col("validation"), F.col("policy")]
    return F.when(F.col(allowed), F.to_json(F.struct(allowed, "request_id", *ends), keep_nulls)).otherwise(
        F.to_json(F.struct(allowed, "request_id", "reason", "code", *ends), keep_nulls))


def _by_day(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("day", F.to_date(ts))


def write_by_day(df: DataFrame, path: str, *, ts: str = "ts", mode: str = "append") -> None:
    """Parquet partitioned by event day, so readers and rotation prune by day.
    Rows are rebalanced by day before writing: adaptive execution gives a day
    that holds much of the data as many writers as its size needs, and small
    days few files."""
    _by_day(df, ts).hint("rebalance", "day").write.mode(mode).partitionBy("day").parquet(path)


def append_audit(events: DataFrame, path: str) -> None:
    write_by_day(events.select(*COLUMNS), path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("day")


def newest_events(spark: SparkSession, path: str, keep: int = AUDIT_RETENTION) -> DataFrame:
    """The *keep* newest entries of a log partitioned by day, read from the days
    that hold them.

    One row per day, of the order column alone, tells where they are: every day
    that reaches beyond the seq which *keep* entries surely have is read, so a
    log that was not written in order gives the same entries.
    """
    log = spark.read.parquet(path)
    days = log.groupBy("day").agg(F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high")).collect()
    held, reach = 0, None
    for d in sorted(days, key=lambda d: d["low"], reverse=True):
        held, reach = held + d["n"], d["low"]
        if held >= keep:
            break
    wanted = [d["day"] for d in days if d["high"] >= reach]
    named = F.col("day").isin([d for d in wanted if d is not None])
    return retained(log.where(named | F.col("day").isNull() if None in wanted else named).drop("day"), keep)


def audit_table(events: DataFrame, name: str) -> None:
    """Appends to a catalog table partitioned by day (the form rotation needs)."""
    _by_day(events.select(*COLUMNS), "ts").write.mode("append").format("parquet").partitionBy("day").saveAsTable(name)


def drop_days_before(spark: SparkSession, name: str, day: str) -> int:
    """Log rotation: drops whole day partitions older than *day* (ISO date);
    returns how many.  One row per day comes to the driver."""
    days = [r["partition"].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()]
    old = sorted(d for d in days if d < day)
    for d in old:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (day = DATE'{d}')")
    return len(old)
