"""SparkSession helpers.

The library never creates a session implicitly; callers pass one in.  These
helpers exist for tests, the bench and the batch job entry point.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "opskpi") -> SparkSession:
    """Session with AQE on, UI off and a UTC clock.

    AQE coalesces small shuffle partitions, splits skewed join partitions and
    turns sort-merge joins into broadcast joins only when the measured
    shuffle output is below ``spark.sql.adaptive.autoBroadcastJoinThreshold``
    — the size check behind every dimension join in this library.
    """
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")  # joins of relations bucketed by lot
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("OPSKPI_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is respected as is;
    leaving it unset there is an error.  Only in local mode (tests, bench) a
    scratch folder is created when it is unset.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master or ""
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: point it at shared storage on a cluster "
                           "(a machine-local folder would not survive the loss of an executor)")
    local = tempfile.mkdtemp(prefix="opskpi-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local
