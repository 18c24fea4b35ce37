"""Reading the corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exists(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether the folder has the table; one look at the file system, no job."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def epoch_seconds(c: Column) -> Column:
    """Epoch seconds of a value in seconds, milliseconds, microseconds or nanoseconds, told apart by size; fractions are dropped."""
    size = F.abs(c)
    by = F.when(size >= 10**17, F.lit(10**9)).when(size >= 10**14, F.lit(10**6)).when(size >= 10**11, F.lit(10**3)).otherwise(F.lit(1)).cast("bigint")
    whole = c.cast("bigint")
    return F.call_function("div", whole, by)
