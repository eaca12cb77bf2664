"""Ridge pricing function by firm folds, and the split of representations along it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vectors as vx
from ..functions.durable import durable
from ..functions.order import carried_lag
from . import tiles
from .moments import MAX_COLLECT_BYTES, Moments, fit_moments, total
from .sampling import kfold

ALPHAS = tuple(np.logspace(-3, 3, 50))
DRIVER_GROUPS = 1000  # matrices that must fit on the driver for a panel to be fitted there
POOLED = -1  # year of a model that uses all years
WEIGHTS = "year int, fold int, intercept double, weights array<double>, alpha double, n_train long"


def _scale_of(m: Moments) -> np.ndarray:
    sxx = m.centred()[0]
    s = np.sqrt(np.maximum(np.diag(sxx), 0) / m.n)
    s[s < 1e-12] = 1.0
    return s


def _ridge(m: Moments, alpha: float, scale: np.ndarray) -> np.ndarray:
    """Slopes on the original columns; the penalty applies to the scaled ones."""
    sxx, sxy, _, _, _ = m.centred()
    s = sxx / np.outer(scale, scale) + alpha * np.eye(len(scale))
    return np.linalg.solve(s, sxy / scale) / scale


def _score(m: Moments, b: np.ndarray, fit_on: Moments) -> float:
    """R2 of predictions on ``m``."""
    _, _, _, mx, my = fit_on.centred()
    v = np.concatenate([[-(my - b @ mx)], -b, [1.0]])
    syy = m.centred()[2]
    return float(1 - (v @ m.a @ v) / syy) if syy > 0 else 0.0


def _ridge_path(m: Moments, alphas: Sequence[float], scale: np.ndarray) -> list[np.ndarray]:
    """Slopes for each alpha; many share one decomposition into eigenvectors."""
    if len(alphas) <= 8:
        return [_ridge(m, a, scale) for a in alphas]
    sxx, sxy, _, _, _ = m.centred()
    values, vectors = np.linalg.eigh(sxx / np.outer(scale, scale))
    turned = vectors.T @ (sxy / scale)
    return [vectors @ (turned / (np.maximum(values, 0) + a)) / scale for a in alphas]


def _fit(inner: dict[int, Moments], alphas: Sequence[float], scale: np.ndarray | None):
    """Choose alpha on the inner folds, fit on all of them."""
    m = total(inner)
    sc = _scale_of(m) if scale is None else scale
    best = alphas[0]
    if len(alphas) > 1:
        scores = []
        for f in inner.values():
            if 0 < f.n < m.n:
                rest = m - f
                scores.append([_score(f, b, rest) for b in _ridge_path(rest, alphas, sc)])
        best = alphas[int(np.argmax(np.mean(scores, axis=0)))]
    b = _ridge(m, best, sc)
    _, _, _, mx, my = m.centred()
    intercept = my + m.shift[-1] - b @ (mx + m.shift[:-1])
    return float(intercept), [float(v) for v in b], float(best), int(round(m.n))


def _prepare(df: DataFrame, xs: Sequence[str] | str, y: str, key: Sequence[str], inner: int) -> DataFrame:
    if isinstance(xs, str) and not key:
        raise ValueError("inner folds of rows with an array need a key")
    return kfold(df.withColumnRenamed("fold", "_outer"), inner, list(key) or [*xs, y], seed=7).withColumnRenamed(
        "fold", "_inner").withColumnRenamed("_outer", "fold")


def _is_wide(xs: Sequence[str] | str, wide: bool | None) -> bool:
    """Named columns of which even many groups of matrices fit on the driver are fitted there."""
    if wide is not None:
        return wide or isinstance(xs, str)
    return isinstance(xs, str) or 8 * (len(xs) + 2) ** 2 * DRIVER_GROUPS > MAX_COLLECT_BYTES


def _pricing_tiles(data: DataFrame, xs: Sequence[str] | str, y: str, alphas: Sequence[float], scaling: str,
                   models: Callable[[list], list[tuple]], pooled: int | None) -> DataFrame:
    """Weights from tiled moments; the driver sees row counts per (year, fold, inner fold), never a matrix."""
    rows = durable(tiles.wide_rows(data, xs, y, ["year", "fold", "_inner"]))
    spark = data.sparkSession
    chosen = set(models([tuple(r) for r in rows.groupBy("year", "fold", "_inner").count().collect()]))
    if not chosen:
        return spark.createDataFrame([], WEIGHTS)
    width, means = tiles.width_and_means(rows)
    blocks = tiles.tiled_moments(rows, ["year", "fold", "_inner"], means)
    scale = np.ones(width - 2) if scaling == "none" else None
    if scaling == "all":
        first, diagonal = tiles.total_variances(blocks, width)
        scale = np.sqrt(np.maximum(diagonal - first ** 2 / first[0], 0) / first[0])[1:-1]
        scale[scale < 1e-12] = 1.0
    elif scaling not in ("none", "train"):
        raise ValueError(f"unknown scaling {scaling}")
    training = tiles.training_tiles(blocks.withColumnRenamed("_inner", "inner"), chosen, pooled)
    alphas = list(alphas)
    return tiles.solved_models(training, width, means, lambda parts: _fit(parts, alphas, scale), WEIGHTS)


def _sum_by_inner(parts: list[dict[int, Moments]]) -> dict[int, Moments]:
    out: dict[int, Moments] = {}
    for p in parts:
        for i, m in p.items():
            out[i] = out[i] + m if i in out else m
    return out


def _common_scale(groups: dict, scaling: str, width: int) -> np.ndarray | None:
    if scaling == "all":
        return _scale_of(total(groups))
    if scaling == "none":
        return np.ones(width)
    if scaling == "train":
        return None
    raise ValueError(f"unknown scaling {scaling}")


def pricing_pooled(
    df: DataFrame, xs: Sequence[str] | str, y: str, alphas: Sequence[float] = ALPHAS, inner: int = 3,
    scaling: str = "train", key: Sequence[str] = (), wide: bool | None = None,
) -> DataFrame:
    """Weights per firm fold (column ``fold``), fitted on the other folds.

    One data pass gives the moments of every (fold, inner fold); the training
    set of a fold is the sum of the others.  ``xs``: column names, or one array
    column.  Wide panels (by size, or ``wide``) are fitted in the tasks.
    """
    if _is_wide(xs, wide):
        def models(counts: list[tuple]) -> list[tuple]:
            folds = {f for _, f, _, _ in counts if f is not None}
            return [(POOLED, f) for f in folds if any(g != f for _, g, _, _ in counts)]

        data = _prepare(df, xs, y, key, inner).withColumn("year", F.lit(POOLED))
        return _pricing_tiles(data, xs, y, alphas, scaling, models, POOLED)
    groups = fit_moments(_prepare(df, xs, y, key, inner), xs, y, ["fold", "_inner"])
    scale = _common_scale(groups, scaling, len(xs))
    folds = sorted({f for f, _ in groups if f is not None})
    rows = []
    for f in folds:
        train = _sum_by_inner([{i: m} for (g, i), m in groups.items() if g != f])
        if train:
            rows.append((POOLED, f, *_fit(train, alphas, scale)))
    return df.sparkSession.createDataFrame(rows, WEIGHTS)


def pricing_forward(
    df: DataFrame, xs: Sequence[str] | str, y: str, alphas: Sequence[float] = ALPHAS, inner: int = 3,
    scaling: str = "train", min_prior: int = 0, min_train: int = 10, key: Sequence[str] = (), wide: bool | None = None,
) -> DataFrame:
    """Weights per (year, fold), fitted on earlier years and other folds.

    Moments by (year, fold, inner fold) come from one pass; running sums over the
    years replace a fit per year over the data.  ``xs`` and ``wide`` as in
    ``pricing_pooled``.
    """
    data = _prepare(df.where(F.col("year").isNotNull() & F.col("fold").isNotNull()), xs, y, key, inner)
    if _is_wide(xs, wide):
        def models(counts: list[tuple]) -> list[tuple]:
            out = []
            for t, f in {(t, f) for t, f, _, _ in counts}:
                prior = [(g, n) for u, g, _, n in counts if u < t]
                if sum(n for _, n in prior) >= max(min_prior, 1) and sum(n for g, n in prior if g != f) >= max(min_train, 1):
                    out.append((t, f))
            return out

        return _pricing_tiles(data, xs, y, alphas, scaling, models, None)
    groups = fit_moments(data, xs, y, ["year", "fold", "_inner"])
    scale = _common_scale(groups, scaling, len(xs))
    years, folds = sorted({g[0] for g in groups}), sorted({g[1] for g in groups})
    past: dict[int, dict[int, Moments]] = {f: {} for f in folds}
    rows = []
    for t in years:
        n_prior = sum(m.n for p in past.values() for m in p.values())
        for f in folds:
            if n_prior < max(min_prior, 1) or not any(g[0] == t and g[1] == f for g in groups):
                continue
            train = _sum_by_inner([past[g] for g in folds if g != f])
            if sum(m.n for m in train.values()) < min_train:
                continue
            rows.append((int(t), f, *_fit(train, alphas, scale)))
        for f in folds:
            past[f] = _sum_by_inner([past[f], {g[2]: m for g, m in groups.items() if g[:2] == (t, f)}])
    return df.sparkSession.createDataFrame(rows, WEIGHTS)


def pricing_weights(weights: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Long table (year, fold, feature, weight)."""
    names = F.array(*[F.lit(x) for x in xs])
    return weights.select("year", "fold", F.posexplode("weights").alias("_i", "weight")).select(
        "year", "fold", F.get(names, F.col("_i")).alias("feature"), "weight")


def _with_weights(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Left join of the weights: per fold if pooled, else per (year, fold); at most years x folds rows."""
    pooled = weights.where(F.col("year") == POOLED).select(
        F.col("fold").alias("_f"), F.col("intercept").alias("_i0"), F.col("weights").alias("_w0"))
    dated = weights.where(F.col("year") != POOLED).select(
        F.col("fold").alias("_g"), F.col("year").alias("_y"), F.col("intercept").alias("_i1"),
        F.col("weights").alias("_w1"))
    return (
        df.join(F.broadcast(pooled), F.col("fold") == F.col("_f"), "left")
        .join(F.broadcast(dated), (F.col("fold") == F.col("_g")) & (F.col("year") == F.col("_y")), "left")
        .withColumn("_w", F.coalesce("_w1", "_w0")).withColumn("_b0", F.coalesce("_i1", "_i0"))
        .drop("_f", "_g", "_y", "_i0", "_i1", "_w0", "_w1")
    )


def predict(df: DataFrame, weights: DataFrame, z: str = "z", fill: float | None = None) -> DataFrame:
    """Out-of-fold prediction; null (or ``fill``) where no model applies."""
    pred = F.col("_b0") + vx.dot(vx.as_double(F.col(z)), F.col("_w"))
    if fill is not None:
        pred = F.coalesce(pred, F.lit(fill))
    return _with_weights(df, weights).withColumn("prediction", pred).drop("_w", "_b0")


def fit_quality(df: DataFrame, y: str, pred: str = "prediction") -> DataFrame:
    """R2, correlation, RMSE over rows with both values."""
    both = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    err = F.col(y) - F.col(pred)
    return both.agg(
        F.count("*").alias("n"), (1 - F.sum(err * err) / (F.var_pop(y) * F.count("*"))).alias("r2"),
        F.corr(y, pred).alias("correlation"), F.sqrt(F.avg(err * err)).alias("rmse"))


def _along(v: Column, w: Column) -> Column:
    """Factor of w in the projection of v on w."""
    ww = vx.squared_norm(w)
    return F.when(ww > 0, vx.dot(v, w) / ww).otherwise(F.lit(0.0))


def decompose(df: DataFrame, weights: DataFrame, z: str = "z") -> DataFrame:
    """Parts of z along and across the weights; the projection matrix is never formed."""
    v = vx.as_double(F.col(z))
    return (
        _with_weights(df, weights).withColumn("_c", _along(v, F.col("_w")))
        .withColumn("z_on", vx.scale(F.col("_w"), F.col("_c")))
        .withColumn("z_perp", vx.subtract(v, F.col("z_on"))).drop("_w", "_b0", "_c")
    )


def check_decomposition(df: DataFrame, z: str = "z", tol: float = 1e-6) -> DataFrame:
    """Largest reconstruction error and whether it is within the tolerance."""
    gap = vx.subtract(vx.as_double(F.col(z)), F.zip_with("z_on", "z_perp", lambda a, b: a + b))
    return df.agg(F.max(F.array_max(F.transform(gap, F.abs))).alias("max_error"), F.count("z_on").alias("n")).withColumn(
        "ok", F.col("max_error") <= tol)


def firm_diff(
    df: DataFrame, z: str = "z", keys: Sequence[str] = ("cik", "item_type"),
    order: Sequence[str] = ("filing_date", "accession_number"),
) -> DataFrame:
    """Change of z since the previous filing of the firm; null on the first and where a key is null.

    The lag runs per firm and calendar quarter with the last filing of earlier
    quarters handed on, so a firm with very many filings is spread.
    """
    quarter = F.year("filing_date") * 4 + F.quarter("filing_date")
    lagged = carried_lag(df, list(keys), quarter, list(order), [z])
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    prev = F.when(known, F.col(f"prev_{z}"))
    return lagged.withColumn(
        f"delta_{z}", F.when(prev.isNotNull(), vx.subtract(vx.as_double(F.col(z)), vx.as_double(prev)))
    ).drop(f"prev_{z}", "prev_exists")


def priced_change(df: DataFrame, weights: DataFrame, delta: str = "delta_z") -> DataFrame:
    """Weighted change w . dz; null on the first filing or without weights."""
    return _with_weights(df, weights).withColumn(
        "priced_change", vx.dot(F.col(delta), F.col("_w"))).drop("_w", "_b0")


def change_norms(df: DataFrame, weights: DataFrame, delta: str = "delta_z", fill: float | None = None) -> DataFrame:
    """Squared and plain norms of the change along and across the weights; missing filled if asked for."""
    d, c = F.col(delta), _along(F.col(delta), F.col("_w"))
    on = vx.squared_norm(vx.scale(F.col("_w"), F.col("_c")))
    perp = vx.squared_norm(vx.subtract(d, vx.scale(F.col("_w"), F.col("_c"))))
    out = _with_weights(df, weights).withColumn("_c", F.when(d.isNotNull(), c))
    cols = {"norm_priced_squared": on, "norm_orthogonal_squared": perp,
            "norm_priced": F.sqrt(on), "norm_orthogonal": F.sqrt(perp)}
    if fill is not None:
        cols = {k: F.coalesce(v, F.lit(fill)) for k, v in cols.items()}
    return out.withColumns(cols).drop("_w", "_b0", "_c")


def pricing_summary(df: DataFrame, y: str, n_features: int) -> DataFrame:
    """One-row summary of a pricing run over predictions, priced changes and norms."""
    err = F.col(y) - F.col("prediction")
    both = F.col(y).isNotNull() & F.col("prediction").isNotNull()
    yy = F.when(both, F.col(y))
    on, perp = F.sqrt(F.avg("norm_priced_squared")), F.sqrt(F.avg("norm_orthogonal_squared"))
    return df.agg(
        F.count("*").alias("n_documents"), F.lit(n_features).alias("n_features"),
        (1 - F.sum(F.when(both, err * err)) / (F.var_pop(yy) * F.count(yy))).alias("r2"),
        F.corr(y, "prediction").alias("correlation"), F.avg("priced_change").alias("mean_priced_change"),
        on.alias("rms_priced"), perp.alias("rms_orthogonal"), (perp / on).alias("ratio"),
    )
