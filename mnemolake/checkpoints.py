"""Cutting lineage with reliable checkpoints."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder of spark.checkpoint.dir; sets a local one only where nothing is set and all runs on this machine.

    On a cluster the folder must be shared, so it is an error not to name one. Set
    spark.cleaner.referenceTracking.cleanCheckpoints to have Spark remove what is no longer used.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, computed once and read from the shared checkpoint folder from then on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
