"""Cutting lineage through Parquet tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode, where all tasks see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="filingpanel-"))


def durable_folder(spark: SparkSession) -> str:
    """Name of a new folder in the shared one, that ``clear_durable`` deletes."""
    path = f"{shared_folder(spark)}/durable-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files: columns stay apart, so later reads are pruned."""
    spark = df.sparkSession
    path = durable_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_durable(spark: SparkSession) -> None:
    """Delete what ``durable`` has written in this application; results built on it cannot be read any more."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
