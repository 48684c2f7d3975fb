"""The folder that driver and executors share, and checkpoints in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; in local mode a temporary folder where it names none.

    On a cluster a machine-local folder would lose files, so an unnamed one is an error there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillion-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4()}"


def saved(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: for loops, in which the constraints that a checkpoint keeps would double each round."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
