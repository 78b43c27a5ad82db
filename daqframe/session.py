"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a fresh local folder if the driver runs the tasks itself, as in tests; on a cluster hosts share no such folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, prefix: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def checkpointed(frame: DataFrame) -> DataFrame:
    """frame with its lineage cut by a reliable checkpoint; for small rows that are read several times."""
    context = frame.sparkSession.sparkContext
    folder = shared_folder(frame.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return frame.checkpoint(eager=True)
