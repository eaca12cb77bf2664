"""Watch a growing training log: a file stream in place of a polling loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.concepts import last_points, plateau_of_tail


def loss_plateau_stream(
    log: DataFrame, out: str, checkpoint: str, run: Sequence[str] = ("run",), step: Sequence[str] = ("step",),
    window: int = 10, available_now: bool = False, every: str = "30 seconds",
) -> StreamingQuery:
    """Start a query that keeps the status of every run; read it with ``latest_status``.

    The state is the number of points and the last points of each run. Each batch reads the state of the batch before
    and writes its own next to it, so its cost follows the batch and the number of runs, not the history, and a batch
    that is repeated after a failure replaces itself. A status is a new folder, complete once its success file is
    there, so readers never find a half-written one.
    """
    run, step = list(run), list(step)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark, new = batch.sparkSession, batch.select(*run, *step, "loss")
        counts = new.groupBy(*run).agg(F.count("*").alias("n_points"))
        if batch_id:
            before = f"{out}/state/{batch_id - 1}"
            new = new.unionByName(spark.read.parquet(f"{before}/tail"))
            counts = counts.unionByName(spark.read.parquet(f"{before}/counts")).groupBy(*run).agg(F.sum("n_points").alias("n_points"))
        now = f"{out}/state/{batch_id}"
        last_points(new, run, step, window).write.mode("overwrite").parquet(f"{now}/tail")
        counts.write.mode("overwrite").parquet(f"{now}/counts")
        plateau_of_tail(spark.read.parquet(f"{now}/tail"), spark.read.parquet(f"{now}/counts"), run, step, window).write.mode(
            "overwrite").parquet(f"{out}/status/{batch_id}")

    writer = log.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def latest_status(spark: SparkSession, out: str) -> DataFrame:
    """The newest complete status."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/status")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [int(f.getPath().getName()) for f in fs.listStatus(folder)
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{out}/status/{max(done)}")
