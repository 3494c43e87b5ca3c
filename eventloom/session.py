"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def use_utc(spark: SparkSession) -> SparkSession:
    """Set the session time zone every time column is read in."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Start a local session for tests and benchmarks.

    On a cluster the job gets its session from the cluster; nothing in the
    package reads these settings.
    """
    return use_utc(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("eventloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Return the shared folder that lineage cuts and stream checkpoints go to.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    may go without one, and gets a fresh temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a shared folder on a cluster")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="eventloom-"))
    return spark.sparkContext.getCheckpointDir()
