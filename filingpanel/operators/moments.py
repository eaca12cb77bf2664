"""Moment tables: additive cross products per group, the one data pass behind every linear model.

A row is read as a = (1, x_1 - s_1, ..., x_p - s_p, y - s_y) with a fixed shift s
for numerical safety.  Each task adds up matrix products per group; the partial
rows are summed by an aggregate with map-side combine.  A group of any size is
just more terms of the sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .concepts import matrix

_FLUSH_BYTES = 256 << 20  # partial matrices held per task before they are passed on
MAX_COLLECT_BYTES = 1 << 30  # all matrices of a fit on the driver
SUM_COLUMNS = 8  # up to so many columns, constant and y included, many groups are plain sums


@dataclass
class Moments:
    """Cross products of one group: index 0 is the constant, the last one y."""

    a: np.ndarray
    shift: np.ndarray  # of x_1..x_p, y

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.a + other.a, self.shift)

    def __sub__(self, other: "Moments") -> "Moments":
        return Moments(self.a - other.a, self.shift)

    @property
    def n(self) -> float:
        return float(self.a[0, 0])

    def centred(self) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, float]:
        """Centred Sxx, Sxy, Syy and the means of x and y (still shifted)."""
        m = self.a[0, 1:] / self.n
        s = self.a[1:, 1:] - self.n * np.outer(m, m)
        return s[:-1, :-1], s[:-1, -1], float(s[-1, -1]), m[:-1], float(m[-1])

    def columns(self, keep: Sequence[int]) -> "Moments":
        """Moments of a subset of the regressors."""
        idx = [0] + [1 + i for i in keep] + [self.a.shape[0] - 1]
        return Moments(self.a[np.ix_(idx, idx)], np.append(self.shift[list(keep)], self.shift[-1]))


def _number(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def column_means(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Means used as shift: one number per column."""
    row = df.agg(*[F.avg(_number(c)) for c in cols]).first()
    return np.array([0.0 if v is None else v for v in row])


def _groups(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple]:
    """(row selector, key values) per group of one batch."""
    if not keys:
        yield slice(None), ()
        return
    codes = np.zeros(batch.num_rows, dtype=np.int64)
    for k in keys:
        d = batch.column(k).dictionary_encode("encode")
        codes = codes * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=codes[order[0]] - 1))
    for s, e in zip(starts, [*starts[1:], len(order)]):
        yield order[s:e], tuple(batch.column(k)[int(order[s])].as_py() for k in keys)


def moments(
    df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str] = (), shift: np.ndarray | None = None,
    weight: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Rows of the cross-product matrix per group: (by..., i, row).  Incomplete rows are left out.

    ``weight`` maps the matrix of shifted rows to one factor per row.
    """
    p = len(xs) + 2
    move = np.zeros(p) if shift is None else np.concatenate([[0.0], shift])
    a = F.array(F.lit(1.0), *[_number(x) for x in xs], _number(y))
    complete = df.dropna(subset=[*xs, y]).select(*by, a.alias("_a"))
    flush = max(1, _FLUSH_BYTES // (8 * p * p))
    keys = list(by)
    schema = T.StructType(
        [complete.schema[k] for k in keys]
        + [T.StructField("i", T.IntegerType()), T.StructField("part", T.ArrayType(T.DoubleType()))]
    )

    def emit(sums: dict, kinds: list) -> pa.RecordBatch:
        flat = np.concatenate([m for m in sums.values()]) if sums else np.zeros((0, p))
        cols = [pa.array([g[n] for g in sums for _ in range(p)], type=t) for n, t in enumerate(kinds)]
        index = pa.array(np.tile(np.arange(p, dtype=np.int32), len(sums)))
        offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * p)
        return pa.RecordBatch.from_arrays(
            cols + [index, pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))], keys + ["i", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        kinds: list = []
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            if batch.num_rows == 0:
                continue
            x = matrix(batch.column("_a")) - move
            w = x if weight is None else x * weight(x)[:, None]
            for rows, group in _groups(batch, keys):
                sums[group] = sums.get(group, 0.0) + w[rows].T @ x[rows]
                if len(sums) >= flush:
                    yield emit(sums, kinds)
                    sums = {}
        if sums:
            yield emit(sums, kinds)

    partial = complete.mapInArrow(run, schema)
    return partial.groupBy(*keys, "i").agg(
        vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("row")
    )


def moments_of_many(df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str], shift: np.ndarray) -> DataFrame:
    """``moments`` for groups that may hold few rows each, such as clusters: with few columns one built-in sum per product,
    combined before the shuffle, so no step is done group by group."""
    p = len(xs) + 2
    if p > SUM_COLUMNS:
        return moments(df, xs, y, by, shift)
    moved = [F.lit(1.0), *[_number(c) - float(s) for c, s in zip([*xs, y], shift)]]
    complete = df.dropna(subset=[*xs, y]).select(*by, *[c.alias(f"_a{i}") for i, c in enumerate(moved)])
    sums = complete.groupBy(*by).agg(*[F.sum(F.col(f"_a{i}") * F.col(f"_a{j}")).alias(f"_m{i}_{j}") for i in range(p) for j in range(i, p)])
    rows = [F.struct(F.lit(i).alias("i"), F.array(*[F.col(f"_m{min(i, j)}_{max(i, j)}") for j in range(p)]).alias("row")) for i in range(p)]
    return sums.select(*by, F.inline(F.array(*rows)))


def fit_moments(
    df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str] = (), shift: np.ndarray | None = None,
    weight: Callable[[np.ndarray], np.ndarray] | None = None,
) -> dict[tuple, Moments]:
    """Moment matrices per group on the driver: groups x (p + 2)^2 numbers, checked."""
    if shift is None:
        shift = column_means(df, [*xs, y])
    p = len(xs) + 2
    table = moments(df, xs, y, by, shift, weight)
    groups: dict[tuple, np.ndarray] = {}
    for r in table.toLocalIterator():
        key = tuple(r[k] for k in by)
        if key not in groups:
            if (len(groups) + 1) * p * p * 8 > MAX_COLLECT_BYTES:
                raise ValueError("too many groups for this number of columns; fit fewer groups per call")
            groups[key] = np.zeros((p, p))
        groups[key][r["i"]] = r["row"]
    return {k: Moments(a, shift) for k, a in groups.items()}


def total(parts: dict[tuple, Moments]) -> Moments:
    it = iter(parts.values())
    out = next(it)
    for m in it:
        out = out + m
    return out
