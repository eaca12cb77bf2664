"""Hash ranks: a seeded, partition-independent random order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .durable import durable

_PREFIX = 4  # hex digits: 65,536 buckets, a fixed bound for the bucket table


def hash_rank(seed: int, *key: str | Column) -> Column:
    """md5 of ``seed|key...`` as 32 hex digits; sorting by it is a random permutation."""
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _lowest_buckets(df: DataFrame, limit: Column | int, rank: str, extra: DataFrame | None = None) -> DataFrame:
    sizes = df.groupBy(F.substring(rank, 1, _PREFIX).alias("_b")).agg(F.count("*").alias("_c"))
    w = Window.orderBy("_b")
    sizes = sizes.select(
        "_b", "_c",
        F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    lim = F.lit(limit) if isinstance(limit, int) else limit
    return sizes.withColumn("_limit", lim.cast("long")).where(F.col("_before") < F.col("_limit"))


def lowest_ranked(df: DataFrame, limit: int | Column, rank: Column) -> DataFrame:
    """The ``limit`` rows with the lowest rank; ``limit`` may use the row count ``_total``.

    The ranks alone are written out and give the rank where the sample ends: row counts per rank prefix tell which
    prefix is cut, and only that one is sorted. The rows themselves are then read once more, with a filter.
    """
    ranked = df.withColumn("_rank", rank)
    ranks = durable(ranked.select("_rank"))
    buckets = durable(_lowest_buckets(ranks, limit, "_rank"))  # at most 65,536 rows
    full = F.col("_before") + F.col("_c") <= F.col("_limit")
    cut = ranks.join(F.broadcast(buckets.where(~full)), F.substring("_rank", 1, _PREFIX) == F.col("_b"))
    cut = cut.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy("_rank"))).where(
        F.col("_before") + F.col("_n") <= F.col("_limit"))
    whole = buckets.where(full).agg(F.max("_b")).first()[0]
    end, taken = cut.agg(F.max("_rank"), F.max_by(F.struct("_before", "_n"), F.struct("_rank", "_n"))).first()
    if end is None:
        return ranked.where(F.substring("_rank", 1, _PREFIX) <= F.lit(whole)).select(*df.columns)
    below, equal = ranks.agg(F.count_if(F.col("_rank") < end), F.count_if(F.col("_rank") == end)).first()
    room = taken["_before"] + taken["_n"] - below
    if room >= equal:
        return ranked.where(F.col("_rank") <= end).select(*df.columns)
    last = ranked.where(F.col("_rank") == end).limit(room)  # rows that repeat one key
    return ranked.where(F.col("_rank") < end).unionByName(last).select(*df.columns)


def hash_position(df: DataFrame, rank: Column, name: str) -> DataFrame:
    """0-based position of each row in rank order (windows per rank prefix only)."""
    ranked = df.withColumn("_rank", rank).withColumn("_b", F.substring("_rank", 1, _PREFIX))
    sizes = ranked.groupBy("_b").agg(F.count("*").alias("_c"))
    offsets = sizes.select(
        "_b",
        F.coalesce(
            F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    inside = Window.partitionBy("_b").orderBy("_rank")
    return (
        ranked.withColumn(name, F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_b")
        .withColumn(name, F.col(name) + F.col("_before"))
        .select(*df.columns, name)
    )


def cap_per_group(
    df: DataFrame, keys: list[str], n: int, rank: Column, null_cap: int | None = None, salt_digits: int = 1
) -> DataFrame:
    """At most ``n`` rows per key, those of lowest rank; null keys may have their own cap.

    The cap is taken per (key, rank prefix) first, so one hot key is spread over
    ``16**salt_digits`` tasks and at most ``n * 16**salt_digits`` of its rows meet.
    """
    top = max(n, null_cap or 0)
    ranked = df.withColumn("_rank", rank)
    if salt_digits:
        salted = Window.partitionBy(*keys, F.substring("_rank", 1, salt_digits)).orderBy("_rank")
        ranked = ranked.withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= top).drop("_n")
    ranked = ranked.withColumn(
        "_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_rank"))
    ).where(F.col("_n") <= top)
    if null_cap is not None:
        missing = F.col(keys[0]).isNull()
        ranked = ranked.where(
            F.when(missing, F.col("_n") <= null_cap).otherwise(F.col("_n") <= n)
        )
    return ranked.select(*df.columns)
