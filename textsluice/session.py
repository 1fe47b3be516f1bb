"""Session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: str | int = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks.  On a cluster the session
    comes from ``spark-submit`` and only needs the UTC zone."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("textsluice")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder reliable checkpoints go to: the cluster's
    ``spark.checkpoint.dir``, or a scratch folder where a local session has
    none.  A cluster without one is refused, since executors could not share
    a machine-local folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="textsluice-checkpoint-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()
