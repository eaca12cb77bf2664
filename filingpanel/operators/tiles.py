"""Cross products of wide panels as tiles: a symmetric block matrix per group, kept in a DataFrame.

A matrix of thousands of columns for each of hundreds of groups fits neither into the driver nor into a worker at once.
Here its lower blocks are rows (group, block row, block column, numbers). A task holds the matrix of one chunk of one group
while it adds up rows, or one block position while it runs over the years, or the matrices of one model while it solves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.durable import durable
from .concepts import matrix
from .moments import Moments

TILE = 64  # rows and columns of a block
CHUNK_ROWS = 1 << 17  # rows of a group that one task adds up


def wide_rows(df: DataFrame, xs: Sequence[str] | str, y: str, by: Sequence[str]) -> DataFrame:
    """``by..., _a``: complete rows as (1, x_1..x_p, y); ``xs``: names of columns, or of one array column."""
    number = F.col(y).cast("double")
    if isinstance(xs, str):
        x = F.transform(F.col(xs), lambda v: v.cast("double"))
        full = df.where(F.col(xs).isNotNull() & F.forall(xs, lambda v: v.isNotNull()))
    else:
        x, full = F.array(*[F.col(c).cast("double") for c in xs]), df.dropna(subset=list(xs))
    return full.where(F.col(y).isNotNull()).select(*by, F.concat(F.array(F.lit(1.0)), x, F.array(number)).alias("_a"))


def width_and_means(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Length of the rows and their means without the leading one; rows of different lengths are an error."""
    low, high = rows.agg(F.min(F.size("_a")), F.max(F.size("_a"))).first()
    if low is None:
        return 0, np.zeros(0)
    if low != high:
        raise ValueError("rows have different numbers of columns")
    return high, np.array(rows.agg(vector_to_array(Summarizer.mean(array_to_vector("_a")))).first()[0][1:])


def _runs(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, int, int]]:
    """(key, first row, end) of each run of equal keys."""
    values, start = list(zip(*[batch.column(k).to_pylist() for k in keys])) or [()] * batch.num_rows, 0
    for i in range(1, batch.num_rows + 1):
        if i == batch.num_rows or values[i] != values[start]:
            yield values[start], start, i
            start = i


def _cut(a: np.ndarray, tile: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Lower blocks of a symmetric matrix."""
    for i in range(0, len(a), tile):
        for j in range(0, i + 1, tile):
            yield i // tile, j // tile, a[i:i + tile, j:j + tile]


def _rows_of(keys: list[tuple], kinds: list[pa.DataType], names: list[str], blocks: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.append(0, np.cumsum([b.size for b in blocks])).astype(np.int32)
    flat = pa.array(np.concatenate([b.ravel() for b in blocks]))
    columns = [pa.array(c, k) for c, k in zip(zip(*keys), kinds)]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), flat)], [*names, "part"])


def tiled_moments(rows: DataFrame, by: Sequence[str], shift: np.ndarray, tile: int = TILE, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``by..., bi, bj, part``: blocks of the sums of a a' over the rows of each group, a = (1, x - shift, y - shift).

    Rows are dealt by group and, in large groups, by a hash, and sorted, so a task holds one matrix at a time. Null keys
    are a group of their own. Blocks of groups in several chunks are added up by an aggregate.
    """
    by, move = list(by), np.append(0.0, shift)
    counts = durable(rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("_chunks")))
    several = counts.agg(F.max("_chunks")).first()[0] or 1
    joined = rows
    if several > 1:
        named = counts.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(by)], "_chunks")
        same = F.lit(True)
        for n, k in enumerate(by):
            same = same & rows[k].eqNullSafe(named[f"_k{n}"])
        joined = rows.join(named, same) if by else rows.withColumn("_chunks", F.lit(several))
        joined = joined.withColumn("_salt", F.pmod(F.xxhash64("_a"), F.col("_chunks")).cast("int"))
    else:
        joined = rows.withColumns({"_chunks": F.lit(1), "_salt": F.lit(0)})
    order = [*by, "_salt"]
    dealt = joined.select(*by, "_salt", "_chunks", "_a").repartition(*order).sortWithinPartitions(*order)
    fields = [dealt.schema[k] for k in by]
    schema = T.StructType([*fields, T.StructField("_chunks", T.IntegerType()), T.StructField("bi", T.IntegerType()),
                           T.StructField("bj", T.IntegerType()), T.StructField("part", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kinds, total, chunks = None, [], None, 0

        def out() -> pa.RecordBatch:
            cut = list(_cut(total, tile))
            return _rows_of([(*now[:-1], chunks, i, j) for i, j, _ in cut], [*kinds, pa.int32(), pa.int32(), pa.int32()],
                            [*by, "_chunks", "bi", "bj"], [b for *_, b in cut])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(k).type for k in by]
            x = matrix(batch.column("_a")) - move
            for key, a, b in _runs(batch, order):
                if key != now:
                    if total is not None:
                        yield out()
                    now, total, chunks = key, np.zeros((x.shape[1],) * 2), batch.column("_chunks")[a].as_py()
                total += x[a:b].T @ x[a:b]
        if total is not None:
            yield out()

    made = durable(dealt.mapInArrow(run, schema))
    if several == 1:
        return made.drop("_chunks")
    whole = made.where("_chunks > 1").groupBy(*by, "bi", "bj").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part"))
    return made.where("_chunks = 1").drop("_chunks").unionByName(whole)


def training_tiles(tiles: DataFrame, models: set[tuple], pooled: int | None = None) -> DataFrame:
    """``year, fold, inner, bi, bj, part``: blocks of the training sets of the models (year, fold).

    ``tiles`` are per year, fold and inner fold. A model trains on the other folds of earlier years; with ``pooled`` (its
    year) on the other folds of all rows. A task runs over the years of one block position after the other and holds one
    running sum per fold and inner fold.
    """
    order = ["bi", "bj", "year", "fold", "inner"]
    years = {}
    for year, fold in models:
        years.setdefault(year, []).append(fold)
    names, kinds = ["year", "fold", "inner", "bi", "bj"], [pa.int32()] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, year, past, coming = None, None, {}, {}

        def trained(t: int) -> Iterator[pa.RecordBatch]:
            keys, blocks = [], []
            for fold in sorted(years.get(t, ())):
                for inner in sorted({i for _, i in past}):
                    others = [s for (g, i), s in past.items() if i == inner and g != fold]
                    if others:
                        keys.append((t, fold, inner, *place))
                        blocks.append(np.sum(others, axis=0))
            if keys:
                yield _rows_of(keys, kinds, names, blocks)

        def passed() -> None:
            for k, s in coming.items():
                past[k] = past[k] + s if k in past else s
            coming.clear()

        for batch in batches:
            part = batch.column("part")
            flat, offsets = part.flatten().to_numpy(), part.offsets.to_numpy() - part.offsets[0].as_py()
            for n, (bi, bj, t, fold, inner) in enumerate(zip(*[batch.column(c).to_pylist() for c in order])):
                if (bi, bj) != place:
                    passed()
                    if pooled is not None and place is not None:
                        yield from trained(pooled)
                    place, year, past = (bi, bj), None, {}
                if t != year:
                    passed()
                    year = t
                    if pooled is None:
                        yield from trained(t)
                coming[fold, inner] = flat[offsets[n]:offsets[n + 1]].copy()
        passed()
        if pooled is not None and place is not None:
            yield from trained(pooled)

    numbered = tiles.select(*[F.col(c).cast("int").alias(c) for c in order], "part")
    sorted_ = numbered.repartition("bi", "bj").sortWithinPartitions(*order)
    return sorted_.mapInArrow(run, "year int, fold int, inner int, bi int, bj int, part array<double>")


def assembled(table: pa.Table, width: int, tile: int = TILE) -> np.ndarray:
    """The matrix of which the rows of the table are the lower blocks."""
    a = np.zeros((width, width))
    for batch in table.to_batches():
        part = batch.column("part")
        flat, offsets = part.flatten().to_numpy(), part.offsets.to_numpy() - part.offsets[0].as_py()
        for n, (i, j) in enumerate(zip(batch.column("bi").to_pylist(), batch.column("bj").to_pylist())):
            rows, cols = slice(i * tile, (i + 1) * tile), slice(j * tile, (j + 1) * tile)
            block = flat[offsets[n]:offsets[n + 1]].reshape(min(tile, width - i * tile), -1)
            a[rows, cols] = block
            a[cols, rows] = block.T
    return a


def solved_models(training: DataFrame, width: int, shift: np.ndarray, fit: Callable[[dict[int, Moments]], tuple], schema: str,
                  tile: int = TILE) -> DataFrame:
    """One row per model, (year, fold, *fit(moments by inner fold)); a task holds the matrices of one model."""
    fields = T._parse_datatype_string(schema)

    def run(table: pa.Table) -> pa.Table:
        inner = table.column("inner").to_numpy()
        parts = {int(i): Moments(assembled(table.filter(pa.array(inner == i)), width, tile), shift) for i in np.unique(inner)}
        row = (table.column("year")[0].as_py(), table.column("fold")[0].as_py(), *fit(parts))
        return pa.Table.from_pylist([dict(zip(fields.names, row))], schema=_arrow(fields))

    return training.groupBy("year", "fold").applyInArrow(run, fields)


def _arrow(fields: T.StructType) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in fields])


def total_variances(tiles: DataFrame, width: int, tile: int = TILE) -> np.ndarray:
    """Sums of a a' over all groups, only the first column and the diagonal: one number per column each, as (2, width)."""
    def picked(first: bool) -> DataFrame:
        side = F.least(F.lit(tile), F.lit(width) - F.col("bj") * tile)
        at = F.col("i") * side if first else F.col("i") * (side + 1)
        rows = tiles.where(F.col("bj") == 0 if first else F.col("bi") == F.col("bj"))
        each = rows.select("bi", "bj", "part", F.explode(F.sequence(F.lit(0), F.least(F.lit(tile), F.lit(width) - F.col("bi") * tile) - 1)).alias("i"))
        return each.select((F.col("bi") * tile + F.col("i")).alias("n"), F.get("part", at.cast("int")).alias("v")).groupBy("n").agg(F.sum("v").alias("v"))

    out = np.zeros((2, width))
    for k, first in enumerate((True, False)):
        for r in picked(first).collect():
            out[k, r["n"]] = r["v"]
    return out
