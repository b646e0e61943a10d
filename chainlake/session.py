"""SparkSession construction and shared-storage helpers.

Everything that sizes the job (shuffle partitions, file split size, AQE
thresholds) lives here so that one place decides how the library behaves at
scale.  On a real cluster the session is created by the platform; call
``configure(spark)`` on it to apply the library's SQL settings.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that change plans, not just logging.  AQE re-plans at stage
# boundaries: it coalesces small shuffle partitions, splits skewed join
# partitions and turns a sort-merge join into a broadcast join only after it
# has measured the materialised side -- the size-checked broadcast with a
# shuffle join as the fallback.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SQL_SETTINGS.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "chainlake") -> SparkSession:
    """Local/test session.  On a cluster, pass the platform session to
    ``configure`` instead."""
    master = master or os.environ.get("CHAINLAKE_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CHAINLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    )
    for k, v in SQL_SETTINGS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def size_shuffle_partitions(spark: SparkSession, input_bytes: int,
                            target_bytes: int = 256 * 1024 * 1024, floor: int = 200) -> int:
    """Set ``spark.sql.shuffle.partitions`` from the input size (about one
    partition per ``target_bytes`` of shuffled input, e.g. ~400,000 for
    100 TB).  AQE then coalesces small partitions and splits skewed ones, so
    the setting is an upper bound on parallelism rather than a guess."""
    n = max(floor, int(input_bytes // target_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names it.  Where it is unset a local session, whose tasks all
    share the driver's disk, gets a scratch folder; any other session is an
    error, since its executors could not see such a folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="chainlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder, for written tables and
    streaming checkpoints."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
