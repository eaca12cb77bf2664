"""Fit k-sparse encoders: distributed passes with parameter averaging.

Rows are dealt to a fixed number of virtual shards by a hash of their key.  In
each epoch every shard streams its rows in a seeded order through Adam steps,
starting from the shared parameters; parameters and Adam moments are then
averaged, weighted by rows, per neuron and in the order of the shards.  So the
result depends on the data, the seed and the number of shards, to the last bit,
but not on the cluster or on partitions.  With one shard this is plain
mini-batch Adam.

Parameters are rows of a table, one per model and neuron, that the tasks write
and read; the driver sees one loss per model and epoch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.durable import durable
from ..functions.sampling import hash_rank, lowest_ranked
from .concepts import MAX_MODEL_BYTES, EncoderWeights, KSparseEncoderModel, encode, matrix

# The default grid and optimiser settings.
GRID_M = (4096, 8192, 16384)
GRID_K = (16, 32, 64)
REPLICAS = 5
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
SHARDS = 32  # of the rows, whatever the size of the cluster
_CENTRE = -1  # row of the decoder offset in the parameter table
_STATE = "replica int, neuron int, step long, value array<double>"


def initial_row(neuron: int, m: int, d: int, seed: int) -> np.ndarray:
    """Uniform start within 1/sqrt(fan-in): encoder, bias and decoder of a neuron, or the decoder offset."""
    r, a, b = np.random.default_rng([seed, neuron - _CENTRE]), 1 / np.sqrt(d), 1 / np.sqrt(m)
    if neuron == _CENTRE:
        return r.uniform(-b, b, d)
    return np.concatenate([r.uniform(-a, a, d + 1), r.uniform(-b, b, d)])


def initial(m: int, d: int, seed: int) -> EncoderWeights:
    """The start as matrices."""
    rows = np.stack([initial_row(j, m, d, seed) for j in range(m)])
    return EncoderWeights(rows[:, :d], rows[:, d], rows[:, d + 1:], initial_row(_CENTRE, m, d, seed))


def gradients(x: np.ndarray, w: EncoderWeights, k: int) -> tuple[float, list[np.ndarray]]:
    """Mean squared error of the reconstruction and its gradient for w_enc, b, w_dec, c."""
    z = encode(x, w, k)
    gap = z @ w.w_dec + w.c - x
    g = 2.0 * gap / gap.size
    dz = (g @ w.w_dec.T) * (z > 0)
    return float(np.mean(gap ** 2)), [dz.T @ x, dz.sum(0), z.T @ g, g.sum(0)]


@dataclass
class AdamState:
    """Parameters [w_enc, b, w_dec, c] with first and second moments."""

    params: list[np.ndarray]
    first: list[np.ndarray]
    second: list[np.ndarray]
    step: int = 0

    @classmethod
    def of(cls, w: EncoderWeights) -> "AdamState":
        p = [w.w_enc, w.b, w.w_dec, w.c]
        return cls([a.copy() for a in p], [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p])

    @property
    def weights(self) -> EncoderWeights:
        return EncoderWeights(*self.params)

    def update(self, grads: list[np.ndarray], lr: float) -> None:
        self.step += 1
        c1, c2 = 1 - BETA1 ** self.step, 1 - BETA2 ** self.step
        for p, m, v, g in zip(self.params, self.first, self.second, grads):
            m *= BETA1
            m += (1 - BETA1) * g
            v *= BETA2
            v += (1 - BETA2) * g * g
            p -= lr * (m / c1) / (np.sqrt(v / c2) + EPSILON)

    def rows(self) -> Iterator[tuple[int, np.ndarray]]:
        """One vector per neuron and one for the decoder offset."""
        sets = (self.params, self.first, self.second)
        per_neuron = np.concatenate([np.concatenate([s[0], s[1][:, None], s[2]], axis=1) for s in sets], axis=1)
        yield from enumerate(per_neuron)
        yield _CENTRE, np.concatenate([s[3] for s in sets])

    @classmethod
    def from_rows(cls, rows: dict[int, np.ndarray], m: int, d: int, step: int) -> "AdamState":
        stack = np.stack([rows[i] for i in range(m)])
        sets = []
        for s in range(3):
            part, off = stack[:, s * (2 * d + 1):(s + 1) * (2 * d + 1)], rows[_CENTRE][s * d:(s + 1) * d]
            sets.append([part[:, :d].copy(), part[:, d].copy(), part[:, d + 1:].copy(), off.copy()])
        return cls(*sets, step=step)


def _start(spark: SparkSession, m: int, d: int, replicas: Sequence[int], seed: int) -> DataFrame:
    """First state of the models, made in the tasks; Adam moments are zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for r in replicas:
                rows = [initial_row(j - 1, m, d, seed + r) for j in ids]
                values = [np.concatenate([v, np.zeros(2 * len(v))]) for v in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r] * len(ids), pa.int32()), pa.array([j - 1 for j in ids], pa.int32()), pa.array([0] * len(ids), pa.int64()),
                     pa.array(values, pa.list_(pa.float64()))], ["replica", "neuron", "step", "value"])

    return spark.range(m + 1).mapInArrow(run, _STATE)


def _given(spark: SparkSession, w: EncoderWeights) -> DataFrame:
    """First state of one model with given weights."""
    rows = [(0, j, 0, [float(x) for x in v]) for j, v in AdamState.of(w).rows()]
    return spark.createDataFrame(rows, _STATE)


def _epoch(data: DataFrame, state: DataFrame, shards: int, m: int, d: int, k: int, lr: float, batch: int, order: Column) -> DataFrame:
    """The state after one pass, with the loss of the pass.

    Each shard gets all models first and then its rows in order, in one sorted stream: a task holds the models and one
    batch of rows.
    """
    models = state.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"), F.lit(0).alias("_kind"), F.lit("").alias("_order"),
        "replica", "neuron", "step", "value", F.lit(None).cast("array<float>").alias("_x"), F.lit(None).cast("array<boolean>").alias("_member"))
    rows = data.select(
        "_shard", F.lit(1).alias("_kind"), order.alias("_order"), F.lit(None).cast("int").alias("replica"), F.lit(None).cast("int").alias("neuron"),
        F.lit(None).cast("long").alias("step"), F.lit(None).cast("array<double>").alias("value"), "_x", "_member")
    stream = models.unionByName(rows).repartition("_shard").sortWithinPartitions("_shard", "_kind", "_order", "replica", "neuron")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, steps, fitted = None, {}, {}, None

        def out() -> Iterator[pa.RecordBatch]:
            for r, fit in (fitted or {}).items():
                fit.end()
                if fit.seen:
                    neurons, values = zip(*fit.state.rows())
                    n = len(neurons)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r] * n, pa.int32()), pa.array(neurons, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array([float(fit.seen)] * n),
                         pa.array([fit.loss] * n), pa.array([fit.state.step] * n, pa.int64()), pa.array(list(values), pa.list_(pa.float64()))],
                        ["replica", "neuron", "shard", "rows", "loss", "step", "value"])

        for b in batches:
            marks = np.stack([np.asarray(b.column("_shard")), np.asarray(b.column("_kind"))])
            change = np.flatnonzero(np.any(marks[:, 1:] != marks[:, :-1], axis=0)) + 1
            for start, end in zip([0, *change.tolist()], [*change.tolist(), b.num_rows]):
                if start == end:
                    continue
                if marks[0, start] != shard:
                    yield from out()
                    shard, parts, steps, fitted = int(marks[0, start]), {}, {}, None
                piece = b.slice(start, end - start)
                if marks[1, start] == 0:
                    flat = matrix_rows(piece.column("value"))
                    for r, j, t, v in zip(*[piece.column(c).to_pylist() for c in ("replica", "neuron", "step")], flat):
                        parts.setdefault(r, {})[j] = v.copy()
                        steps[r] = t
                    continue
                if fitted is None:
                    fitted = {r: _Fit(AdamState.from_rows(parts[r], m, d, steps[r]), k, lr, batch) for r in sorted(parts)}
                    parts = {}
                x, member = matrix(piece.column("_x")), np.array(piece.column("_member").to_pylist(), bool).reshape(end - start, -1)
                for i, fit in enumerate(fitted.values()):
                    fit.feed(x[member[:, i]])
        yield from out()

    def mean(table: pa.Table) -> pa.Table:
        """Weighted mean of the shards of one neuron, added up pairwise in the order of the shards."""
        table = table.sort_by("shard")
        weights, values = table["rows"].to_numpy(), matrix_rows(table["value"].combine_chunks())
        total, loss, count = (_pairwise([w * x for w, x in zip(weights, part)]) for part in (values, table["loss"].to_numpy(), np.ones(len(weights))))
        return pa.table([table["replica"][:1], table["neuron"][:1], pa.array([max(table["step"].to_pylist())], pa.int64()),
                         pa.array([(total / count).tolist()], pa.list_(pa.float64())), pa.array([float(loss / count)])],
                        names=["replica", "neuron", "step", "value", "loss"])

    done = stream.mapInArrow(run, "replica int, neuron int, shard int, rows double, loss double, step long, value array<double>")
    return done.groupBy("replica", "neuron").applyInArrow(mean, _STATE + ", loss double")


class _Fit:
    """One model that walks through the rows of a shard."""

    def __init__(self, state: AdamState, k: int, lr: float, batch: int):
        self.state, self.k, self.lr, self.batch = state, k, lr, batch
        self.held, self.seen, self.total = [], 0, 0.0

    def feed(self, rows: np.ndarray) -> None:
        ready = np.concatenate([*self.held, rows]) if self.held else rows
        full = len(ready) // self.batch * self.batch
        for s in range(0, full, self.batch):
            self._step(ready[s:s + self.batch])
        self.held = [ready[full:]] if full < len(ready) else []

    def end(self) -> None:
        for rows in self.held:
            self._step(rows)
        self.held = []

    def _step(self, x: np.ndarray) -> None:
        value, grads = gradients(x, self.state.weights, self.k)
        self.state.update(grads, self.lr)
        self.seen += len(x)
        self.total += value * len(x)

    @property
    def loss(self) -> float:
        return self.total / self.seen


def _pairwise(parts: Sequence):
    """Sum of neighbours, then of neighbours of sums: one order for any number of tasks."""
    parts = list(parts)
    while len(parts) > 1:
        parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def matrix_rows(column: pa.Array) -> list[np.ndarray]:
    """Rows of a list column, of any lengths."""
    flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def _fit(
    data: DataFrame, shards: int, d: int, m: int, k: int, replicas: Sequence[int], lr: float, epochs: int, batch: int, seed: int,
    start: EncoderWeights | None = None,
) -> tuple[DataFrame, list[tuple]]:
    """The last state of the models and the loss log."""
    size = 3 * 8 * (2 * d + 1) * m * len(replicas)
    if size > 4 * MAX_MODEL_BYTES:
        raise ValueError(f"{len(replicas)} models of {m} x {d} need {size} bytes per task; fit fewer at once")
    state = durable(_start(data.sparkSession, m, d, replicas, seed) if start is None else _given(data.sparkSession, start))
    log = []
    for epoch in range(epochs):
        state = durable(_epoch(data, state.drop("loss"), shards, m, d, k, lr, batch, hash_rank(seed + epoch, "_key")))
        seen = state.where(F.col("neuron") == _CENTRE).select("replica", "loss").orderBy("replica").collect()
        if len(seen) < len(replicas):
            raise ValueError("no vector to fit")
        log += [(m, k, r["replica"], epoch + 1, r["loss"]) for r in seen]
    return state, log


def weights_of(state: DataFrame, m: int, d: int, replica: int = 0) -> EncoderWeights:
    """Weights of one model on the driver."""
    rows = {r["neuron"]: np.array(r["value"]) for r in state.where(F.col("replica") == replica).toLocalIterator()}
    return AdamState.from_rows(rows, m, d, 0).weights


def model_rows(state: DataFrame, m: int, k: int, d: int) -> DataFrame:
    """The state as rows of a models table."""
    value = F.col("value")
    return state.where(F.col("neuron") != _CENTRE).select(
        F.lit(m).alias("M"), F.lit(k).alias("k"), "replica", "neuron", F.slice(value, 1, d).alias("w_enc"),
        F.get(value, F.lit(d)).alias("b"), F.slice(value, d + 2, d).alias("w_dec"))  # as in schemas.ENCODER_MODEL


LOG = "M int, k int, replica int, epoch int, loss double"


class KSparseEncoder:
    """Estimator: ``fit`` gives a model and its loss log; ``start``: weights to begin with."""

    def __init__(self, m: int = 1024, k: int = 32, lr: float = 1e-3, epochs: int = 10, batch: int = 1024, seed: int = 42,
                 shards: int | None = None, start: EncoderWeights | None = None):
        self.m, self.k, self.lr, self.epochs, self.batch, self.seed, self.start = m, k, lr, epochs, batch, seed, start
        self.shards = shards or SHARDS

    def fit(self, df: DataFrame, key: Sequence[str], vector: str = "embedding") -> KSparseEncoderModel:
        data, d = _prepare(df, key, vector, self.shards, F.array(F.lit(True)))
        state, log = _fit(data, self.shards, d, self.m, self.k, [0], self.lr, self.epochs, self.batch, self.seed, self.start)
        model = KSparseEncoderModel(weights_of(state, self.m, d), self.k)
        model.loss_log = df.sparkSession.createDataFrame(log, LOG)
        return model


def _prepare(df: DataFrame, key: Sequence[str], vector: str, shards: int, member: Column) -> tuple[DataFrame, int]:
    """Rows with their shard, and the length of the vectors."""
    number = F.conv(F.substring(hash_rank(0, "_key"), 1, 8), 16, 10).cast("long")
    data = durable(
        df.where(F.col(vector).isNotNull()).select(
            F.concat_ws("|", *key).alias("_key"), F.col(vector).cast("array<float>").alias("_x"), member.alias("_member"))
        .withColumn("_shard", (number % shards).cast("int")))
    d = data.agg(F.max(F.size("_x"))).first()[0]
    if d is None:
        raise ValueError("no vector to fit")
    return data, d


def replica_membership(df: DataFrame, replicas: Sequence[int], frac: float = 0.8, seed: int = 42) -> DataFrame:
    """Filings with a boolean per replica: is the filing in its bootstrap sample?"""
    filings = df.select("accession_number").distinct()
    marks = []
    for r in replicas:
        chosen = lowest_ranked(
            filings, F.floor(F.col("_total") * F.lit(frac)), hash_rank(seed + r, "accession_number"))
        marks.append(chosen.withColumn("_r", F.lit(r)))
    by_filing = reduce(DataFrame.unionByName, marks).groupBy("accession_number").agg(F.collect_set("_r").alias("_in"))
    return by_filing.select("accession_number", F.array(*[F.array_contains("_in", r) for r in replicas]).alias("_member"))


def fit_ensemble(
    df: DataFrame, key: Sequence[str], ms: Sequence[int] = GRID_M, ks: Sequence[int] = GRID_K, replicas: int = REPLICAS,
    subset: str | None = None, frac: float = 0.8, lr: float = 1e-3, epochs: int = 10, batch: int = 1024, seed: int = 42,
    shards: int | None = None, vector: str = "embedding", per_pass: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Models table and loss log over the grid (M, k, replica).

    ``subset`` such as ``"M4096"`` or ``"k32"`` restricts the grid.  A pass over
    the data trains ``per_pass`` replicas of one (M, k) together, each on the
    filings of its own bootstrap sample.
    """
    grid = [(m, k) for m, k in product(ms, ks) if subset is None or subset in (f"M{m}", f"k{k}")]
    if not grid:
        raise ValueError(f"no model in the grid for subset {subset}")
    ids = list(range(replicas))
    member = replica_membership(df, ids, frac, seed)
    shards = shards or SHARDS
    data, d = _prepare(df.join(member, "accession_number"), key, vector, shards, F.col("_member"))
    spark, tables, log = df.sparkSession, [], []
    for m, k in grid:
        for s in range(0, replicas, per_pass or replicas):
            group = ids[s:s + (per_pass or replicas)]
            part = data.withColumn("_member", F.slice("_member", s + 1, len(group)))
            state, lines = _fit(part, shards, d, m, k, group, lr, epochs, batch, seed)
            log += lines
            tables.append(model_rows(state, m, k, d))
    return reduce(DataFrame.unionByName, tables), spark.createDataFrame(log, LOG)
