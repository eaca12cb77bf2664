"""Sparse concept encoder: apply weights to embeddings, shape and filter activations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import vectors as vx
from ..functions.order import global_index
from ..functions.text import lower_tokens

MAX_MODEL_BYTES = 512 << 20  # broadcast bound for one set of encoder weights
_ROWS = 512  # rows per matrix product, so a batch needs rows x M doubles at most

ACTIVATION = T.ArrayType(T.StructType([
    T.StructField("feature_id", T.IntegerType()), T.StructField("value", T.DoubleType())
]))


@dataclass
class EncoderWeights:
    """z = relu(w_enc x + b);  x_hat = w_dec' z + c."""

    w_enc: np.ndarray  # M x d
    b: np.ndarray  # M
    w_dec: np.ndarray | None = None  # M x d
    c: np.ndarray | None = None  # d

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.w_enc, self.b, self.w_dec, self.c) if a is not None)


def closed_form_weights(m: int, d: int, phase: float = 0.0) -> EncoderWeights:
    """Weights sin((j+1)(i+1) + phase): a fixed encoder whose output can be checked in SQL."""
    j, i = np.arange(1, m + 1)[:, None], np.arange(1, d + 1)[None, :]
    return EncoderWeights(np.sin(j * i + phase), np.zeros(m))


def matrix(column: pa.Array) -> np.ndarray:
    """Arrow list column (no nulls, equal lengths) as a matrix."""
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def encode(x: np.ndarray, w: EncoderWeights, k: int | None) -> np.ndarray:
    """relu(w_enc x + b), only the k largest entries of each row kept."""
    z = np.maximum(x @ w.w_enc.T + w.b, 0.0)
    if k is not None and k < z.shape[1]:
        drop = np.argpartition(-z, k - 1, axis=1)[:, k:]
        np.put_along_axis(z, drop, 0.0, axis=1)
    return z


class KSparseEncoderModel:
    """Adds ``activation``: the non-zero (feature_id, value) pairs of each row.

    ``k=None`` gives the dense relu encoder.  ``keep`` restricts the output to
    some neurons after the top-k was taken over all of them.
    """

    def __init__(self, weights: EncoderWeights, k: int | None = 32, keep: list[int] | None = None):
        if weights.nbytes > MAX_MODEL_BYTES:
            raise ValueError(f"encoder of {weights.nbytes} bytes exceeds the broadcast bound {MAX_MODEL_BYTES}")
        self.weights, self.k, self.keep = weights, k, keep

    def transform(self, df: DataFrame, vector: str = "embedding", out: str = "activation") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.weights)
        k, keep = self.k, None if self.keep is None else np.array(sorted(self.keep))
        schema = T.StructType([f for f in df.schema.fields if f.name != vector] + [T.StructField(out, ACTIVATION)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shared.value
            for batch in batches:
                x = matrix(batch.column(vector))
                counts, ids, values = [np.zeros(1, np.int64)], [], []
                for s in range(0, len(x), _ROWS):
                    z = encode(x[s:s + _ROWS], w, k)
                    if keep is not None:
                        z = z[:, keep]
                    r, c = np.nonzero(z)
                    counts.append(np.bincount(r, minlength=len(z)))
                    ids.append(c if keep is None else keep[c])
                    values.append(z[r, c])
                pairs = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate(ids or [[]]).astype(np.int32)),
                     pa.array(np.concatenate(values or [[]]).astype(np.float64))], ["feature_id", "value"])
                offsets = pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32))
                kept = [n for n in batch.schema.names if n != vector]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n) for n in kept] + [pa.ListArray.from_arrays(offsets, pairs)], kept + [out])

        return df.where(F.col(vector).isNotNull()).mapInArrow(run, schema)


def to_long(df: DataFrame, keys: list[str], activation: str = "activation") -> DataFrame:
    """One row per non-zero activation."""
    return df.select(*keys, F.inline(activation)).select(*keys, "feature_id", "value")


def to_wide(long: DataFrame, keys: list[str], features: list[int], prefix: str = "h_") -> DataFrame:
    """One column per listed feature, zero where inactive; for export only."""
    wide = long.groupBy(*keys).pivot("feature_id", features).agg(F.first("value"))
    return wide.select(*keys, *[F.coalesce(F.col(str(f)), F.lit(0.0)).alias(f"{prefix}{f}") for f in features])


def wide_to_long(wide: DataFrame, keys: list[str], prefix: str = "h_") -> DataFrame:
    """Non-zero entries of the feature columns named by prefix."""
    cols = [c for c in wide.columns if c.startswith(prefix)]
    pairs = F.array(*[
        F.struct(F.lit(c[len(prefix):]).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols
    ])
    return wide.select(*keys, F.inline(F.filter(pairs, lambda p: p["value"] != 0)))


def l2_normalize(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.withColumn(vector, vx.l2_normalised(vx.as_double(F.col(vector))))


def rescale_to_sqrt_dim(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Multiply all rows by sqrt(dimension) / mean row norm."""
    v = vx.as_double(F.col(vector))
    factor = df.agg((F.sqrt(F.max(F.size(vector))) / F.avg(vx.norm(v))).alias("f")).scalar()
    return df.withColumn("_f", factor).withColumn(vector, vx.scale(v, F.col("_f"))).drop("_f")


def activation_stats(df: DataFrame, m: int, activation: str = "activation") -> DataFrame:
    """Mean number of active features per row, and as a share of all features."""
    return df.agg(F.avg(F.size(activation)).alias("mean_active")).withColumn(
        "mean_frequency", F.col("mean_active") / m
    )


def activation_rates(long: DataFrame, rows: DataFrame, features: DataFrame, min_rate: float = 0.01) -> DataFrame:
    """Share of rows with a positive value per feature, and whether it counts as alive."""
    active = long.where(F.col("value") > 0).groupBy("feature_id").agg(F.count("*").alias("n_active"))
    total = rows.agg(F.count("*").alias("n")).scalar()
    rate = F.coalesce("n_active", F.lit(0)) / F.col("_n")
    return (
        features.select("feature_id").join(active, "feature_id", "left").withColumn("_n", total)
        .select("feature_id", rate.alias("rate"), (rate >= min_rate).alias("alive"))
    )


def alive_features(long: DataFrame, rows: DataFrame, min_rate: float = 0.01) -> DataFrame:
    """Activations of the alive features only."""
    rates = activation_rates(long, rows, long.select("feature_id").distinct(), min_rate)
    return long.join(rates.where("alive").select("feature_id"), "feature_id", "left_semi")


def feature_name(m: Column, k: Column, neuron: Column) -> Column:
    return F.format_string("h_M%d_k%d_n%d", m, k, neuron)


def feature_metadata(stable: DataFrame) -> DataFrame:
    """Name and global position of each stable feature (one row per neuron, model-sized)."""
    named = stable.withColumn("feature_name", feature_name(F.col("M"), F.col("k"), F.col("neuron_idx")))
    return global_index(named, ["M", "k", "neuron_idx"], "global_feature_idx").select(
        "feature_name", "M", "k", "neuron_idx", "mean_similarity", "global_feature_idx"
    )


def load_weights(models: DataFrame, m: int, k: int, replica: int) -> EncoderWeights:
    """Weights of one model; model-sized, so they may pass through the driver."""
    rows = (
        models.where((F.col("M") == m) & (F.col("k") == k) & (F.col("replica") == replica))
        .select("neuron", "w_enc", "b", "w_dec").toPandas().sort_values("neuron")
    )
    if len(rows) != m:
        raise ValueError(f"model M={m} k={k} replica={replica} has {len(rows)} neurons")
    return EncoderWeights(np.stack(rows["w_enc"]), rows["b"].to_numpy(), np.stack(rows["w_dec"]))


def stable_activations(
    df: DataFrame, models: DataFrame, stable: DataFrame, keys: list[str], vector: str = "embedding"
) -> DataFrame:
    """Long activations of the stable neurons of replica 0, over all (M, k)."""
    wanted: dict[tuple[int, int], list[int]] = {}
    for r in stable.select("M", "k", "neuron_idx").collect():  # at most one row per neuron
        wanted.setdefault((r["M"], r["k"]), []).append(r["neuron_idx"])
    if not wanted:
        raise ValueError("no stable feature")
    out = None
    for (m, k), neurons in sorted(wanted.items()):
        model = KSparseEncoderModel(load_weights(models, m, k, 0), k, neurons)
        part = to_long(model.transform(df.select(*keys, vector), vector), keys).select(
            *keys, feature_name(F.lit(m), F.lit(k), F.col("feature_id")).alias("feature"), "value"
        )
        out = part if out is None else out.unionByName(part)
    return out


def hashed_counts(text: Column, dim: int) -> Column:
    """Signed counts of the lower-case tokens and token pairs of a text, in ``dim`` places: an array of longs.

    The MD5 of a token says where it counts (first eight hex digits modulo ``dim``) and with which sign (minus for an odd
    ninth digit). The nine digits are one number, whose ninth keeps only its last bit. Places are found by one sort of all codes
    together with each possible code once, so the work grows with the text and ``dim``, not with their product.
    """
    def code(gram: Column) -> Column:  # 16 * place, one more for minus
        return F.conv(F.substring(F.md5(gram), 1, 9), 16, 10).cast("long").bitwiseAND(~14) % (16 * dim)

    def coded(words: Column) -> Column:
        pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)),
                           lambda a, b: code(F.concat(a, F.lit(" "), b)))
        return F.concat(F.transform(words, code), pairs, every)

    def ends(codes: Column) -> Column:
        """Where each code has its last place in the sorted array."""
        last = F.transform(codes, lambda x, i: F.when((i == F.size(codes) - 1) | (x != F.get(codes, i + 1)), i))
        return F.filter(last, lambda i: i.isNotNull())

    def counts(last: Column) -> Column:
        def minus(i: Column) -> Column:  # ends 2 i (plus) and 2 i + 1 (minus)
            before = F.coalesce(F.get(last, 2 * i - 1), F.lit(-1))
            return (F.get(last, 2 * i) - before) - (F.get(last, 2 * i + 1) - F.get(last, 2 * i))

        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), minus)

    every = F.concat(*[F.sequence(F.lit(sign), F.lit(16 * dim - 16 + sign), F.lit(16)).cast("array<long>") for sign in (0, 1)])
    codes = vx.let(lower_tokens(F.coalesce(text, F.lit(""))), coded)
    return vx.let(vx.let(F.sort_array(codes), ends), counts)


def embed(df: DataFrame, encoder=None, dim: int = 384, text: str = "text", out: str = "embedding") -> DataFrame:
    """Unit-length embedding per text; null and empty texts have the zero vector.

    ``encoder`` is a plug point: a function returning a function from a list of
    texts to a matrix, called once per task.  The default needs no model and no
    Python: ``hashed_counts``, scaled to length one.
    """
    if encoder is None:
        def unit(counts: Column) -> Column:
            length = F.sqrt(F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x * x))
            return vx.let(F.greatest(length, F.lit(1e-12)), lambda n: F.transform(counts, lambda x: (x / n).cast("float")))

        return df.withColumn(out, vx.let(hashed_counts(F.col(text), dim), unit))

    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder()
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            x = np.asarray(model(texts), np.float32).reshape(len(texts), -1)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            col = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays(list(batch.columns) + [col], batch.schema.names + [out])

    return df.mapInArrow(run, schema)


def loss_plateau(log: DataFrame, run: list[str], step: list[str], window: int = 10, tol: float = 0.001) -> DataFrame:
    """Per run: relative improvement of the last window over the one before, trend of the last points.

    Only the last ``2 * window`` points of a run reach its window.
    """
    points = log.groupBy(*run).agg(F.count("*").alias("n_points"))
    return plateau_of_tail(last_points(log, run, step, window), points, run, step, window, tol)


def last_points(log: DataFrame, run: list[str], step: list[str], window: int = 10) -> DataFrame:
    """The points of each run that the plateau check looks at."""
    order = Window.partitionBy(*run).orderBy(*[F.desc(s) for s in step])
    return log.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(2 * window, 10)).drop("_r")


def plateau_of_tail(
    points_kept: DataFrame, points: DataFrame, run: list[str], step: list[str], window: int = 10, tol: float = 0.001
) -> DataFrame:
    """``loss_plateau`` from ``last_points`` and a table with the number of points per run."""
    n = F.col("_r")
    order = Window.partitionBy(*run).orderBy(*[F.desc(s) for s in step])
    tail = points_kept.withColumn("_r", F.row_number().over(order))
    prev = F.avg(F.when((n > window) & (n <= 2 * window), F.col("loss")))
    recent = F.avg(F.when(n <= window, F.col("loss")))
    stats = tail.groupBy(*run).agg(
        prev.alias("_prev"), recent.alias("_recent"),
        F.max(F.when(n == 1, F.col("loss"))).alias("_last"), F.max(F.when(n == 10, F.col("loss"))).alias("_tenth"),
        F.avg(F.when(n <= 10, F.col("loss"))).alias("last10_mean"),
        F.stddev_pop(F.when(n <= 10, F.col("loss"))).alias("last10_std"),
    )
    rate = F.when(F.col("_prev") > 0, (F.col("_prev") - F.col("_recent")) / F.col("_prev")).otherwise(0.0)
    enough, ten = F.col("n_points") >= 2 * window, F.col("n_points") >= 10
    return stats.join(points, run).select(
        *run, "n_points",
        F.when(enough, rate).alias("improvement"), (enough & (rate < tol)).alias("converged"),
        F.when(ten, F.when(F.col("_last") < F.col("_tenth"), "decreasing").otherwise("flat or increasing"))
        .alias("trend"),
        F.when(ten, F.col("last10_mean")).alias("last10_mean"), F.when(ten, F.col("last10_std")).alias("last10_std"),
    )
