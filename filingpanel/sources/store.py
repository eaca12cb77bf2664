"""Tables written between steps: partitioned Parquet, embedding store, result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.order import global_index


def spread(scan: DataFrame, partitions: int | str | None, *key: str) -> DataFrame:
    """A scan redistributed by key into ``partitions`` parts if a number is given, else as it is.

    For tables stored as one row group, which would keep all text work in one task.
    """
    return scan.repartition(int(partitions), *key) if partitions else scan


def write_by(df: DataFrame, path: str, *partition: str, drop: list[str] | None = None) -> None:
    """Parquet partitioned by the given columns (e.g. item_type), optionally without the text."""
    out = df.drop(*(drop or []))
    out.write.mode("overwrite").partitionBy(*partition).parquet(path)


def write_result(df: DataFrame, path: str, fmt: str = "csv") -> None:
    if fmt not in ("csv", "json"):
        raise ValueError(f"unknown result format {fmt}")
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.json(path)


def write_embeddings(df: DataFrame, path: str, keys: list[str], vector: str = "embedding") -> None:
    """Embeddings keyed by sentence; float arrays, one Parquet table."""
    df.select(*keys, F.col(vector).cast("array<float>").alias(vector)).write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def embedding_index(df: DataFrame, order: list[str], chunk_size: int = 100_000) -> DataFrame:
    """Chunk table (chunk_idx, start, end, n, path) of rows in key order; ``end`` is exclusive."""
    idx = global_index(df.select(*order), order, "_row")
    chunk = F.floor(F.col("_row") / chunk_size).cast("long")
    return (
        idx.groupBy(chunk.alias("chunk_idx"))
        .agg(F.min("_row").alias("start"), (F.max("_row") + 1).alias("end"), F.count("*").alias("n"))
        .withColumn("path", F.format_string("embeddings_chunk_%04d", "chunk_idx"))
    )
