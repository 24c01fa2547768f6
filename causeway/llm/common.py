"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def by_value(module: str) -> None:
    """Worker functions of the module travel with their closure, so executors need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: a lambda variable holds it, and the optimizer can't copy it into inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df lacks, whatever its letters' case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    """Reduce-side partitions for what a query gathers: the session's setting, which grows with the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, so a lost executor costs no recomputation; the shuffle files behind it go when it is written."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))  # local mode: one machine
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # select: a plan of its own, made under the setting
    finally:
        spark.conf.set(CLEANUP, before)
