"""Global positions and running values without a single-task window.

``ordered_slices`` range-partitions and sorts the rows and materialises the
result, so each row has a fixed slice and a fixed position in it.  Everything
global is then a join with one row per slice (bounded by the number of
partitions), never a window over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .durable import durable

_SLICE, _POS = "_slice", "_pos"
_POS_BITS = 33  # monotonically_increasing_id: partition number << 33 | row number


def ordered_slices(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows in the given total order with their slice and position in the slice."""
    mono = F.col("_mono")
    return durable(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mono", F.monotonically_increasing_id())
        .withColumn(_SLICE, F.shiftright(mono, _POS_BITS).cast("int"))
        .withColumn(_POS, mono - F.shiftleft(F.col(_SLICE).cast("long"), _POS_BITS))
        .drop("_mono")
    )


def _before() -> Window:
    return Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)


def global_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the 0-based position of each row in the order of ``order``."""
    rows = ordered_slices(df, order)
    offsets = rows.groupBy(_SLICE).count().select(
        _SLICE, F.coalesce(F.sum("count").over(_before()), F.lit(0)).alias("_offset")
    )
    return (
        rows.join(F.broadcast(offsets), _SLICE)  # one row per partition
        .withColumn(name, F.col("_offset") + F.col(_POS))
        .drop(_SLICE, _POS, "_offset")
    )


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add the inclusive running sum of ``value`` in the order of ``order``."""
    rows = ordered_slices(df, order)
    carry = rows.groupBy(_SLICE).agg(F.sum(value).alias("_part")).select(
        _SLICE, F.coalesce(F.sum("_part").over(_before()), F.lit(0)).alias("_carry")
    )
    inside = Window.partitionBy(_SLICE).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn(name, F.sum(value).over(inside))
        .join(F.broadcast(carry), _SLICE)
        .withColumn(name, F.col(name) + F.col("_carry"))
        .drop(_SLICE, _POS, "_carry")
    )


def running_min_from_end(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Add the minimum of ``value`` over the row itself and all rows after it."""
    rows = ordered_slices(df.withColumn("_v", value), order)
    after = Window.orderBy(F.desc(_SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(_SLICE).agg(F.min("_v").alias("_part")).select(
        _SLICE, F.min("_part").over(after).alias("_carry")
    )
    inside = Window.partitionBy(_SLICE).orderBy(_POS).rowsBetween(0, Window.unboundedFollowing)
    return (
        rows.withColumn(name, F.min("_v").over(inside))
        .join(F.broadcast(carry), _SLICE)
        .withColumn(name, F.least(F.col(name), F.coalesce(F.col("_carry"), F.col(name))))
        .drop(_SLICE, _POS, "_carry", "_v")
    )


def carried_lag(
    df: DataFrame, keys: list[str], bucket: Column, order: list[str], cols: list[str], prefix: str = "prev_"
) -> DataFrame:
    """Previous row's ``cols`` per key, for keys of any size.

    The rows of a key are windowed per bucket (a coarse, order-preserving part
    of the order, e.g. the month); the last row of each earlier bucket is handed
    on through a table with one row per key and bucket.
    """
    src = df.withColumn("_bucket", bucket).withColumn("_has", F.lit(True))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    payload = F.struct("_has", *cols)
    last = src.groupBy(*keys, "_bucket").agg(
        F.max_by(payload, F.struct(*order)).alias("_last")
    )
    across = Window.partitionBy(*keys).orderBy("_bucket")
    handed = last.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_kb"),
                         F.lag("_last").over(across).alias("_handed"))
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_bucket") == F.col("_kb")]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    local = src.withColumn("_local", F.lag(payload).over(inside))
    prev = F.coalesce(F.col("_local"), F.col("_handed"))
    return (
        local.join(handed, on, "left")
        .select(*df.columns, *[prev[c].alias(prefix + c) for c in cols],
                F.coalesce(prev["_has"], F.lit(False)).alias(prefix + "exists"))
    )
