"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from ..sources.io import durable as materialize
from ..sources.io import one_machine, release, scratch
from ..sources.proxies import table

__all__ = ["materialize", "release", "scratch", "shared_dir", "small_batches", "table"]

#: Rows of an Arrow batch handed to Python; texts are long, so batches are small.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = 32 << 20) -> None:
    """Bound the memory of Arrow batches of whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on one machine (tests) one of our own where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not one_machine(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="fieldsieve-")
        spark.sparkContext.setCheckpointDir(path)
    return path
