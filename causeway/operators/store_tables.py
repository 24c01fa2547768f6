"""Tables between the rounds of an iterative operator, written where driver and executors share a folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir, so a lost executor costs no recomputation of earlier rounds."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))  # local mode: one machine
    return df.checkpoint()
