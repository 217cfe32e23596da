"""Cutting of lineage in the folder that the cluster names."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, written to spark.checkpoint.dir.  Where that setting is absent a
    local folder is made on a single machine; on a cluster it is an error."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of tables that the caller has let go
    of: its cleaner waits for the driver to collect its garbage, which an idle driver puts off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
