"""Cutting lineage so that loops stay short and lost executors don't matter."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Where it names none, a temporary one on a local master; elsewhere that is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="shared-"))
    return folder or context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """A reliable checkpoint of the frame."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: for what loops hand on through joins. Planning over checkpoints slowed down with every round of such loops until it no longer ended; over tables it doesn't."""
    path = f"{shared_dir(frame.sparkSession)}/tables/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
