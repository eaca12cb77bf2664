"""Shared parts: durable tables in the shared folder, text as bytes, small files for the tasks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SHIPPED_BYTES = 64 << 20
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. A temporary one is made only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = tempfile.mkdtemp(prefix="filingpanel-llm-")
    return _LOCAL[key]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the files.

    This cuts the lineage (a lost executor costs no recomputation of earlier stages), keeps columns
    apart for pruning, and lets the planner see the true size of the table.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shipped(spark: SparkSession, path: str):
    """A small file (vocabulary) as a broadcast; its size is checked."""
    size = os.path.getsize(path)
    if size > MAX_SHIPPED_BYTES:
        raise ValueError(f"{path} has {size} bytes; at most {MAX_SHIPPED_BYTES} are sent to the tasks")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so that extra columns cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))


def text_of(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column (null: empty), without decoding."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of text, at least one row."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch.slice(start)
