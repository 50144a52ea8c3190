"""Bounded batches of rows between Spark and its Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on in this session, rows go to Python in batches of ``BATCH_BYTES`` at most (or of one row that is longer), not of 64 MB.

    A batch lies in memory a few times at once, as buffers of Spark and of Arrow, as strings and as bytes, in each task of an executor.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
