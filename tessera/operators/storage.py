"""Where intermediate tables go."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all machines share; without that
    setting a temporary one on a single machine, and an error on a cluster."""
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    base = base or tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has no more than rows rows, else as it is; the count
    reads one row more than that at most."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
