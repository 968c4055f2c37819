"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import textkit


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Only where it is unset (tests on one machine) does a
    temporary folder become the context's checkpoint folder, since nothing else is shared then."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tallybook-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends here, and a
    lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    release(spark)
    back._stored_path = path
    return back


def forget(df: DataFrame | None) -> None:
    """Delete a stored table once nothing reads it any more."""
    path = getattr(df, "_stored_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs now, not at some later
    collection of garbage: they are most of the disk that a sequence of stored steps takes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    textkit.trim()


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows with long ``keys`` as fresh expressions.  A grouped table is already dealt by
    its key, and a join would reuse that dealing, which keeps Spark from splitting a hot key of
    the other side; keyed anew, both sides are dealt for the join alone and can be split."""
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast("long")) for k in keys})
