"""The small side of a join, measured before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .durable import durable_folder

MAX_BROADCAST_BYTES = 256 << 20
_EXPANSION = 8  # rows in memory against their compressed files, at most about


def measured(df: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df``, stored; with a broadcast hint if its files show that it takes at most ``limit`` bytes in memory.

    The planner knows the size of a stored table before anything runs, while adaptive execution only learns it after the
    other side has been shuffled.  So a wide side, such as texts, stays where it is if this one is small enough.
    """
    spark, path = df.sparkSession, durable_folder(df.sparkSession)
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    stored = spark.read.schema(df.schema).parquet(path)
    return F.broadcast(stored) if size * _EXPANSION <= limit else stored
