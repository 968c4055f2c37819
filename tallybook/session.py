"""Session helpers that hold on a laptop and on a cluster alike."""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tallybook", cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # columns are built several times faster
        .config("spark.driver.memory", os.environ.get("TALLYBOOK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder, read through Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once: written to the folder that ``spark.checkpoint.dir`` names, which also cuts its lineage, or, where a session
    names none, persisted (memory, then disk; ``unpersist`` it when done)."""
    if df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine find the package wherever the driver was started.
    A cluster ships it with ``--py-files`` instead."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark
