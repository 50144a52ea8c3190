"""Tables written between two steps of a job.

Cutting a plan with a written table keeps it recoverable: the files lie in a folder that the driver
and all executors share, so a lost executor costs one task and not the whole lineage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (local runs), a new temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def new_dir(spark: SparkSession, tag: str) -> str:
    """A path, not used before, in the application's part of the shared folder."""
    return f"{_own_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written between steps. Results that haven't been written elsewhere can't be read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and return the table that is read back."""
    spark = df.sparkSession
    path = new_dir(spark, tag)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
