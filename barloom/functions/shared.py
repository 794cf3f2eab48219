"""Where intermediate tables go."""

from __future__ import annotations

import functools
import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Input file bytes behind one task of a panel's windows.
TASK_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a session on one machine (local mode) gets a folder of its own; a cluster gets an error,
    as its executors would each write to their own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder()
    return folder.rstrip("/")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="barloom-")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(panel: DataFrame, key: str = "ticker", task_bytes: int = TASK_BYTES) -> DataFrame:
    """The panel hashed by ticker over a number of tasks that grows with the files behind it.

    Windows over wide panels sort a task's rows several times, so the rows of a task decide its memory. Bars are narrow
    when they are exchanged: partitions merged by their bytes would be hundreds of times as large once all columns stand.
    """
    spark, files = panel.sparkSession, panel.inputFiles()
    if not files:
        return panel
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] or 0
    tasks = math.ceil(size / task_bytes)
    return panel.repartition(tasks, key) if tasks > spark.sparkContext.defaultParallelism else panel
