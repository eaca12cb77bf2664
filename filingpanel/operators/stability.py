"""Stability of features across the replicas of a model (model-sized tables)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.durable import durable
from ..functions.quantiles import exact_quantiles

_BLOCK = 512  # neurons on each side of one matrix product
_VALUES = 1 << 21  # numbers in one side of a task, at most about
_LEAST = 2048  # neurons that are worth a part of their own
_TASKS = 160  # wanted per (M, k), if its replicas are large enough
_PAIR = ["M", "k", "i", "a", "j", "b"]


def replica_similarity(models: DataFrame) -> DataFrame:
    """Best cosine match of each neuron of replica i in replica j, for i <> j of one (M, k).

    Each replica is cut into parts, and a task takes one pair of parts of two replicas. Its matrix products serve both
    directions, and each neuron leaves the task with one maximum, so no neuron pair is ever a row. A vector that is
    null matches nothing; its neuron has the similarity null.
    """
    tile = _BLOCK

    def best(key, table):
        m, k, i, _, j, _ = (x.as_py() for x in key)
        left = table.filter(table["left"])
        right = table.filter(pc.invert(table["left"]))
        x, y = _unit_rows(left["w_dec"]), _unit_rows(right["w_dec"])
        found = _best_matches(x, y, tile)
        return pa.concat_tables(_found(m, k, *at, side, s) for at, side, s in zip(((i, j), (j, i)), (left, right), found))

    pairs = _pairs_of_parts(models)
    out = pairs.groupBy(*_PAIR).applyInArrow(best, "M int, k int, i int, j int, neuron int, similarity double")
    return out.groupBy("M", "k", "i", "j", "neuron").agg(F.max("similarity").alias("similarity"))


def _pairs_of_parts(models: DataFrame) -> DataFrame:
    """Each neuron once per part of another replica that it has to meet: the parts a of i and b of j, i < j."""
    rows = models.select(
        *[F.col(c).cast("int").alias(c) for c in ("M", "k", "replica", "neuron")], "w_dec"
    ).where(F.col("replica").isNotNull())
    width = F.greatest(F.max(F.size("w_dec")), F.lit(1))
    sizes = rows.groupBy("M", "k", "replica").agg(F.count("*").alias("n"), width.alias("width"))
    r = F.size("replicas")
    wanted = F.ceil(F.sqrt(_TASKS / F.greatest(r * (r - 1) / 2, F.lit(1.0))))

    def parts(x: Column) -> Column:
        fewest = F.ceil(x["n"] * x["width"] / _VALUES)
        return F.greatest(fewest, F.least(F.col("wanted"), F.ceil(x["n"] / _LEAST))).cast("int")

    # One row per (M, k), with two numbers per replica.
    layout = sizes.groupBy("M", "k").agg(F.collect_list(F.struct("replica", "n", "width")).alias("replicas")).withColumn(
        "wanted", wanted
    ).select("M", "k", F.map_from_entries(
        F.transform("replicas", lambda x: F.struct(x["replica"], parts(x)))).alias("parts"))

    def parts_of(x: Column) -> Column:
        ids = F.sequence(F.lit(0), x["value"] - 1)
        return F.transform(ids, lambda part: F.struct(x["key"].alias("replica"), part.alias("part")))

    others = F.filter(F.map_entries("parts"), lambda x: x["key"] != F.col("replica"))
    meets = rows.join(F.broadcast(layout), ["M", "k"]).select(
        "M", "k", "replica", "neuron", "w_dec",
        F.pmod(F.xxhash64("neuron", "w_dec"), F.col("parts")[F.col("replica")]).cast("int").alias("part"),
        F.flatten(F.transform(others, parts_of)).alias("others"))
    # Exploded on its own, so that nothing above is computed once per copy.
    met = meets.select("M", "k", "replica", "part", F.explode("others").alias("other"), "neuron", "w_dec")
    left = F.col("replica") < F.col("other.replica")
    return met.select(
        "M", "k", F.least("replica", "other.replica").alias("i"), F.when(left, F.col("part")).otherwise(F.col("other.part")).alias("a"),
        F.greatest("replica", "other.replica").alias("j"), F.when(left, F.col("other.part")).otherwise(F.col("part")).alias("b"),
        left.alias("left"), "neuron", "w_dec")


def _unit_rows(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length of the vectors that are not null."""
    vectors = vectors.combine_chunks().drop_null()
    lengths = pc.unique(pc.list_value_length(vectors)).to_pylist() or [0]
    if len(lengths) > 1:
        raise ValueError(f"decoder vectors of different lengths: {lengths[:2]}")
    m = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), lengths[0])
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)


def _best_matches(x: np.ndarray, y: np.ndarray, tile: int) -> tuple[np.ndarray | None, np.ndarray | None]:
    """For each row of ``x`` the largest product with a row of ``y``, and the same the other way round.

    Products in single precision tell, for each row and tile of the other side, how large the products get; those tiles
    that can hold the maximum are computed again in double precision.
    """
    if not (len(x) and len(y)):
        return None, None
    if x.shape[1] != y.shape[1]:
        raise ValueError(f"decoder vectors of different lengths: {[x.shape[1], y.shape[1]]}")
    xs, ys = x.astype(np.float32), y.astype(np.float32)
    nx, ny = -(-len(x) // tile), -(-len(y) // tile)
    x_top, y_top = np.empty((len(x), ny), np.float32), np.empty((len(y), nx), np.float32)
    space = np.empty(tile * tile, np.float32)
    for p in range(nx):
        rows = slice(p * tile, (p + 1) * tile)
        for q in range(ny):
            cols = slice(q * tile, (q + 1) * tile)
            a, b = xs[rows], ys[cols]
            cos = np.matmul(a, b.T, out=space[:len(a) * len(b)].reshape(len(a), len(b)))
            cos.max(axis=1, out=x_top[rows, q])
            cos.max(axis=0, out=y_top[cols, p])
    return _exact(x, y, x_top, tile), _exact(y, x, y_top, tile)


def _exact(x: np.ndarray, y: np.ndarray, top: np.ndarray, tile: int) -> np.ndarray:
    highest = top.max(axis=1, keepdims=True)
    # A product of rows of length 1 in single precision is off by about (width + 2) / 2**24 at most, two by twice that.
    near = top >= highest - np.float32((x.shape[1] + 4) / 2**22)
    out = np.where(np.isnan(highest[:, 0]), np.nan, -np.inf)
    for q in range(top.shape[1]):
        at = np.flatnonzero(near[:, q])
        for part in np.split(at, range(tile, len(at), tile)):
            if len(part):
                cos = x[part] @ y[q * tile:(q + 1) * tile].T
                out[part] = np.maximum(out[part], cos.max(axis=1))
    return out


def _found(m: int, k: int, i: int, j: int, side: pa.Table, best: np.ndarray | None) -> pa.Table:
    """One row per neuron of a side; null where its vector or all of the other side are null, none without another side."""
    neurons = side["neuron"].combine_chunks()
    null = side["w_dec"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
    values = np.zeros(len(neurons))
    if best is None:
        null[:] = True
    else:
        values[~null] = best
    n = len(neurons)
    return pa.table({
        **{name: pa.array(np.full(n, v, np.int32)) for name, v in (("M", m), ("k", k), ("i", i), ("j", j))},
        "neuron": neurons, "similarity": pa.array(values, mask=null)})


def mean_similarity(sim: DataFrame, anchor: int | None = None) -> DataFrame:
    """Mean best match per neuron index over the ordered replica pairs (or those of one anchor replica)."""
    if anchor is not None:
        sim = sim.where(F.col("i") == anchor)
    return sim.groupBy("M", "k", "neuron").agg(F.avg("similarity").alias("mean_similarity"))


def stable_features(sim: DataFrame, threshold: float = 0.8, anchor: int | None = None) -> DataFrame:
    """Neurons whose mean similarity reaches the threshold.

    Indices refer to replica 0.  With fewer than two replicas there is no pair,
    hence no stable feature.
    """
    return mean_similarity(sim, anchor).where(F.col("mean_similarity") >= threshold).withColumnRenamed(
        "neuron", "neuron_idx"
    )


def stability_summary(models: DataFrame, sim: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per (M, k): replicas, features, stable ones, mean / median / std of the similarity, advice on the total."""
    m = durable(mean_similarity(sim))  # a row per neuron, read three times
    reps = models.groupBy("M", "k").agg(F.countDistinct("replica").alias("n_replicas"))
    stats = m.groupBy("M", "k").agg(
        F.count("*").alias("n_features_total"),
        F.count_if(F.col("mean_similarity") >= threshold).alias("n_stable"),
        F.avg("mean_similarity").alias("similarity_mean"), F.stddev_pop("mean_similarity").alias("similarity_std"),
    )
    median = exact_quantiles(m, "mean_similarity", {"similarity_median": 0.5}, ["M", "k"])
    total = stats.agg(F.sum("n_stable").alias("t")).scalar()
    return (
        stats.join(median, ["M", "k"]).join(reps, ["M", "k"])
        .withColumn("pct_stable", F.col("n_stable") * 100 / F.col("n_features_total"))
        .withColumn("threshold", F.lit(threshold)).withColumn("_t", total)
        .withColumn("advice", F.when(F.col("_t") < 200, "few: lower the threshold")
                    .when(F.col("_t") > 2000, "many: raise the threshold").otherwise("in range"))
        .drop("_t")
    )
