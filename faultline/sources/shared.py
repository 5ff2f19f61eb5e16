"""The folder that driver and executors share, and rows kept there."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`. Where it is unset, a session on one machine gets a temporary one;
    on a cluster that is an error, since executors would not see one another's files."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(frame: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so that no later loss of an executor matters."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def release(spark: SparkSession) -> None:
    """Let go of what earlier rounds of a loop no longer need: Spark removes shuffle files, broadcasts and checkpoints
    of frames that its driver has forgotten, which otherwise happens whenever the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(spark: SparkSession, folder: str) -> None:
    """Delete a folder written by an operator."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
