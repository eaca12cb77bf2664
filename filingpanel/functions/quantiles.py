"""Exact quantiles (linear interpolation) without sorting a group in one task.

A sketch with a guaranteed rank error brackets each wanted rank; rows below the
bracket are only counted, and the rows inside it are sorted in many small ranges.
The answer is exact, the sketch only decides what may be skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ACCURACY = 10_000
_PAD = 3.0 / ACCURACY
BINS = 1024


def _numbers(x: DataFrame) -> DataFrame:
    return x.where(F.col("_x").isNotNull() & ~F.isnan("_x"))


# A group of at most ACCURACY rows is taken whole: there a bracket would be off by whole ranks.
def _lower(bound: Column) -> Column:
    return F.when(F.col("_n") <= ACCURACY, F.lit(float("-inf"))).otherwise(bound)


def _upper(bound: Column) -> Column:
    return F.when(F.col("_n") <= ACCURACY, F.lit(float("inf"))).otherwise(bound)


def exact_quantiles(
    df: DataFrame, value: str | Column, qs: dict[str, float], by: list[str] | None = None, few_groups: bool = False
) -> DataFrame:
    """One row per group with a column per entry of ``qs``; null values are skipped.

    ``few_groups`` promises a fixed number of groups (e.g. column names), so the
    bracket table may be broadcast; without groups it is a single row.
    """
    by = by or []
    keys = by or ["_all"]
    col = F.col(value) if isinstance(value, str) else value
    src = df if by else df.withColumn("_all", F.lit(0))
    x = _numbers(src.select(*keys, col.cast("double").alias("_x")))

    names = list(qs)
    probes = [F.lit(max(0.0, qs[n] - _PAD)) for n in names] + [F.lit(min(1.0, qs[n] + _PAD)) for n in names]
    sketch = x.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_x", F.array(*probes), ACCURACY).alias("_p")
    )
    bands = F.array(*[
        F.struct(
            F.lit(n).alias("q"),
            ((F.col("_n") - 1) * F.lit(float(qs[n]))).alias("pos"),
            _lower(F.col("_p")[i]).alias("lo"),
            _upper(F.col("_p")[i + len(names)]).alias("hi"),
        )
        for i, n in enumerate(names)
    ])
    table = sketch.select(*keys, bands.alias("_bands"))
    if by:
        near = x.join(F.broadcast(table) if few_groups else table, keys)
    else:
        near = x.withColumn("_bands", table.select("_bands").scalar())
    found = _select(near, keys)
    found = found.withColumn("_r", F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_pos") - F.floor("_pos")))
    out = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == n, F.col("_r"))).alias(n) for n in names])
    return out.drop("_all")


def sparse_quantile(nonzero: DataFrame, rows: DataFrame, by: str, value: str, q: float, name: str) -> DataFrame:
    """Quantile per ``by`` over all ``rows``, where only positive values are stored.

    The zeros are never made: they shift the wanted rank by their number.  Keys
    whose rank falls among the zeros need no second look at the data.
    """
    grid = 400
    x = _numbers(nonzero.select(by, F.col(value).cast("double").alias("_x")))
    total = rows.agg(F.count("*").alias("n")).scalar()
    sketch = x.groupBy(by).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("_x", F.array(*[F.lit(i / grid) for i in range(grid + 1)]), ACCURACY).alias("_p"),
    ).withColumn("_pos", (total - 1) * F.lit(float(q)) - (total - F.col("_n")))
    share = F.col("_pos") / F.col("_n")
    at = [F.greatest(F.lit(0), F.least(F.lit(grid), i)).cast("int")
          for i in (F.floor((share - _PAD) * grid), F.ceil((share + _PAD) * grid))]
    band = F.struct(F.lit("q").alias("q"), F.col("_pos").alias("pos"),
                    _lower(F.get("_p", at[0])).alias("lo"), _upper(F.get("_p", at[1])).alias("hi"))
    table = sketch.where(F.col("_pos") > -1).select(by, F.array(band).alias("_bands"))
    found = _select(x.join(F.broadcast(table), by), [by])  # one row per feature of the model
    a, z = F.coalesce("_a", F.lit(0.0)), F.coalesce("_z", F.lit(0.0))
    found = found.select(by, (a + (z - a) * (F.col("_pos") - F.floor("_pos"))).alias(name))
    return sketch.select(by).join(found, by, "left").fillna(0.0, [name])


def _select(near: DataFrame, keys: list[str]) -> DataFrame:
    """Values at ranks floor(pos) and ceil(pos) of each (key, quantile), as ``_a`` and ``_z``.

    Per (key, quantile) the rows below the band collapse into one count, and the band is cut into ``BINS`` ranges of
    equal width. Positions run inside a range only; a table of at most ``BINS`` + 1 rows per (key, quantile) tells how
    many rows lie before each range, so no task sorts a whole band.
    """
    hit = near.select(*keys, "_x", F.explode("_bands").alias("_b")).where(F.col("_x") <= F.col("_b.hi"))
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    inside = F.col("_x") >= lo
    width = hi - lo
    place = F.when((width > 0) & (width < float("inf")), F.least(F.floor((F.col("_x") - lo) / width * BINS), F.lit(BINS - 1)))
    part = F.when(~inside, F.lit(-1)).otherwise(F.coalesce(place, F.lit(0))).cast("int")
    cells = hit.groupBy(
        *keys, F.col("_b.q").alias("_q"), F.col("_b.pos").alias("_pos"), part.alias("_part"), F.when(inside, F.col("_x")).alias("_v")
    ).agg(F.count("*").alias("_c"))
    group = [*keys, "_q"]
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cells.groupBy(*group, "_part").agg(F.sum("_c").alias("_n")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate([*group, "_part"])], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.lit(True)
    for i, k in enumerate([*group, "_part"]):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    w = Window.partitionBy(*group, "_part").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumn("_end", F.sum("_c").over(w)).join(parts, same).withColumn("_end", F.col("_end") + F.col("_before"))

    def covers(i: Column) -> Column:
        return (F.col("_end") - F.col("_c") <= i) & (i < F.col("_end"))

    return ranked.groupBy(*group).agg(
        F.first("_pos").alias("_pos"),
        F.max(F.when(covers(F.floor("_pos")), F.col("_v"))).alias("_a"),
        F.max(F.when(covers(F.ceil("_pos")), F.col("_v"))).alias("_z"),
    )
