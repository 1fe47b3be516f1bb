"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Spreads a table read in fewer splits than the cores can use.

    Matching costs far more per byte than moving the text once, so a table of
    few files or few row groups is dealt out evenly first.  A table with enough
    splits, which any large one has, is left as it is: no shuffle.
    """
    wanted = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
