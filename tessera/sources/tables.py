"""Reading the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``root`` (any path that Spark can read)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def table_bytes(spark: SparkSession, root: str, name: str) -> int:
    """Bytes of the table's files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
