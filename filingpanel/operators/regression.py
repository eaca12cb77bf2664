"""Linear models on moment tables: standardising, OLS with robust errors, Lasso with cross-validation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import tails, vectors as vx
from ..functions.durable import durable
from .moments import Moments, column_means, fit_moments, moments_of_many, total
from .sampling import kfold


# ---------------------------------------------------------------- standardise


class Standardize:
    """Zero mean and unit population standard deviation, fitted on one table, applied to others."""

    def __init__(self, cols: Sequence[str]):
        self.cols = list(cols)

    def fit(self, train: DataFrame) -> "StandardizeModel":
        def x(c: str) -> Column:
            return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

        row = train.agg(*[F.avg(x(c)) for c in self.cols], *[F.stddev_pop(x(c)) for c in self.cols]).first()
        n = len(self.cols)
        return StandardizeModel(self.cols, [row[i] or 0.0 for i in range(n)], [row[n + i] or 1.0 for i in range(n)])


@dataclass
class StandardizeModel:
    cols: list[str]
    means: list[float]
    scales: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        """Missing values count as zero before scaling."""
        scaled = {
            c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - m) / s
            for c, m, s in zip(self.cols, self.means, self.scales)
        }
        return df.withColumns(scaled)


# ---------------------------------------------------------------- OLS

ONE_PASS_COLUMNS = 64  # the moments of a cluster are (columns + 2)^2 numbers, its scores columns + 1


@dataclass
class OlsFit:
    names: list[str]  # const first
    coef: np.ndarray
    cov: np.ndarray
    n: int
    r2: float
    ssr: float
    kind: str
    df_resid: int = 0
    extra: dict = field(default_factory=dict)

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))

    @property
    def adj_r2(self) -> float:
        return 1 - (1 - self.r2) * (self.n - 1) / self.df_resid

    def p_values(self) -> list[float]:
        z = self.coef / self.se
        if self.kind == "classic":
            return [tails.t_two_sided(v, self.df_resid) for v in z]
        return [tails.normal_two_sided(v) for v in z]

    def table(self, spark: SparkSession, **labels) -> DataFrame:
        """One row per term; the size of the model."""
        rows = [
            (n, float(b), float(s), float(b / s), float(p), self.n, float(self.r2), float(self.adj_r2))
            for n, b, s, p in zip(self.names, self.coef, self.se, self.p_values())
        ]
        out = spark.createDataFrame(
            rows, "term string, coefficient double, std_error double, statistic double, p_value double, "
            "n long, r2 double, adj_r2 double"
        )
        return out.withColumns({k: F.lit(v) for k, v in labels.items()}) if labels else out


def _solve(m: Moments) -> tuple[np.ndarray, float, float]:
    """Coefficients on the shifted scale (const first), residual and total sum of squares."""
    k = m.a.shape[0] - 1
    xx, xy = m.a[:k, :k], m.a[:k, k]
    b = np.linalg.lstsq(xx, xy, rcond=None)[0]
    _, _, syy, _, _ = m.centred()
    ssr = float(m.a[k, k] - 2 * b @ xy + b @ xx @ b)
    return b, ssr, syy


def _unshift(m: Moments) -> np.ndarray:
    """Linear map of shifted parameters to those of the original columns (without the shift of y)."""
    k = m.a.shape[0] - 1
    t = np.eye(k)
    t[0, 1:] = -m.shift[:-1]
    return t


def ols(
    df: DataFrame, y: str, xs: Sequence[str], cov: str = "HC1", cluster: str | None = None, min_rows: int = 10
) -> OlsFit:
    """OLS with constant.  ``cov``: HC1 or classic; ``cluster`` gives firm-clustered errors.

    One pass for the moments, one for the middle of the sandwich; with clusters and
    at most ``ONE_PASS_COLUMNS`` columns the moments of the clusters serve for both.
    With fewer than two clusters the classic covariance is used.
    """
    data = df.dropna(subset=[*xs, y] + ([cluster] if cluster else []))
    per_cluster = None
    if cluster and len(xs) <= ONE_PASS_COLUMNS:
        shift = column_means(data, [*xs, y])
        per_cluster = durable(moments_of_many(data, xs, y, [cluster], shift))
        m = _summed(per_cluster, shift)
    else:
        m = fit_moments(data, xs, y).get(())
    if m is None or m.n < min_rows:
        raise ValueError(f"fewer than {min_rows} complete rows")
    b, ssr, syy = _solve(m)
    n, k = int(round(m.n)), len(b)
    bread = np.linalg.pinv(m.a[:k, :k])
    kind = "cluster" if cluster else cov
    if kind == "HC1":
        mid = fit_moments(data, xs, y, shift=m.shift, weight=lambda a: (a[:, k] - a[:, :k] @ b) ** 2)[()].a[:k, :k]
        v = bread @ mid @ bread * n / (n - k)
    elif kind == "cluster":
        scores = _cluster_scores(data, y, xs, cluster, m.shift, b) if per_cluster is None else _scores_of(per_cluster, cluster, b)
        g, mid = _outer(scores)
        if g < 2:
            kind = "classic"
        else:
            v = bread @ mid @ bread * g / (g - 1) * (n - 1) / (n - k)
    if kind == "classic":
        v = bread * ssr / (n - k)
    t = _unshift(m)
    coef = t @ b
    coef[0] += m.shift[-1]
    return OlsFit(["const", *xs], coef, t @ v @ t.T, n, 1 - ssr / syy, ssr, kind, n - k)


def _summed(per_cluster: DataFrame, shift: np.ndarray) -> Moments | None:
    """Moments of the whole table from those of its clusters."""
    rows = per_cluster.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")).collect()
    return Moments(np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])]), shift) if rows else None


def _scores_of(per_cluster: DataFrame, cluster: str, b: np.ndarray) -> DataFrame:
    """Sum of x * residual per cluster as X'y - X'X b, from the stored moments."""
    beta = F.array(*[F.lit(float(v)) for v in b])
    score = F.get("row", F.lit(len(b))) - vx.dot(F.slice("row", 1, len(b)), beta)
    return per_cluster.where(F.col("i") < len(b)).groupBy(cluster).agg(
        F.array(*[F.max(F.when(F.col("i") == i, score)) for i in range(len(b))]).alias("s"))


def _cluster_scores(data: DataFrame, y: str, xs: Sequence[str], cluster: str, shift, b) -> DataFrame:
    """Sum of x * residual per cluster: an aggregate, so a hot firm is combined before the shuffle."""
    a = F.array(F.lit(1.0), *[F.col(x).cast("double") - float(s) for x, s in zip(xs, shift)])
    beta = F.array(*[F.lit(float(v)) for v in b])
    e = (F.col(y).cast("double") - float(shift[-1])) - vx.dot(F.col("_a"), beta)
    return (
        data.withColumn("_a", a).withColumn("_e", e)
        .groupBy(cluster).agg(vector_to_array(Summarizer.sum(array_to_vector(vx.scale(F.col("_a"), F.col("_e"))))).alias("s"))
    )


def _outer(scores: DataFrame) -> tuple[int, np.ndarray]:
    k = len(scores.select("s").head()["s"]) if not scores.isEmpty() else 0
    cols = [f"s{i}" for i in range(k)]
    wide = scores.select(*[F.col("s")[i].alias(c) for i, c in enumerate(cols)], F.lit(0.0).alias("_y"))
    m = fit_moments(wide, cols, "_y", shift=np.zeros(k + 1)).get(())
    if m is None:
        return 0, np.zeros((k, k))
    return int(round(m.n)), m.a[1:k + 1, 1:k + 1]


def compare_models(
    df: DataFrame, outcomes: Sequence[str], base: Sequence[str], features: Sequence[str], min_rows: int = 100
) -> DataFrame:
    """Baseline against full model per outcome: R2 of both, their difference, nested F test."""
    rows, xs = [], [*base, *features]
    for y in outcomes:
        m = fit_moments(df, xs, y).get(())
        if m is None or m.n < min_rows:
            continue
        small = m.columns(range(len(base)))
        _, ssr_b, syy = _solve(small)
        _, ssr_f, _ = _solve(m)
        n, kb, kf = int(round(m.n)), len(base) + 1, len(xs) + 1
        f = ((ssr_b - ssr_f) / (kf - kb)) / (ssr_f / (n - kf))
        rows.append((y, n, 1 - ssr_b / syy, 1 - ssr_f / syy, (ssr_b - ssr_f) / syy, float(f),
                     tails.f_upper(f, kf - kb, n - kf)))
    return df.sparkSession.createDataFrame(
        rows, "outcome string, n_obs long, r2_baseline double, r2_full double, delta_r2 double, f_stat double, "
        "f_pval double")


def joint_f_test(spark: SparkSession, fit: OlsFit, names: Sequence[str]) -> DataFrame:
    """Wald F test that all named coefficients are zero."""
    idx = [fit.names.index(n) for n in names if n in fit.names]
    b = fit.coef[idx]
    f = float(b @ np.linalg.pinv(fit.cov[np.ix_(idx, idx)]) @ b / len(idx))
    return spark.createDataFrame(
        [(len(idx), f, tails.f_upper(f, len(idx), fit.df_resid), float(fit.r2), fit.n)],
        "n_features long, f_statistic double, p_value double, r_squared double, n_obs long")


# ---------------------------------------------------------------- Lasso


@dataclass
class LassoModel:
    names: list[str]
    coef: np.ndarray  # on the standardised columns
    means: np.ndarray
    scales: np.ndarray
    intercept: float
    alpha: float
    alphas: np.ndarray
    cv_mse: np.ndarray
    n: int

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(n, float(c)) for n, c in zip(self.names, self.coef)], "feature string, coefficient double")

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Adds the fitted value; missing regressors count as zero, as in fitting."""
        pred = F.lit(self.intercept)
        for n, c, m, s in zip(self.names, self.coef, self.means, self.scales):
            if c != 0.0:
                pred = pred + (F.coalesce(F.col(n).cast("double"), F.lit(0.0)) - float(m)) * float(c / s)
        return df.withColumn(out, pred)


def soft(x: float, t: float) -> float:
    return np.sign(x) * max(abs(x) - t, 0.0)


def _jump(s: np.ndarray, c: np.ndarray, alpha: float, b: np.ndarray) -> bool:
    """Move to the exact solution for the current signs, if it keeps them."""
    on = np.flatnonzero(b)
    if len(on) == 0:
        return False
    try:
        exact = np.linalg.solve(s[np.ix_(on, on)], c[on] - alpha * np.sign(b[on]))
    except np.linalg.LinAlgError:
        return False
    if np.any(np.sign(exact) != np.sign(b[on])):
        return False
    b[on] = exact
    return True


def lasso_path(
    s: np.ndarray, c: np.ndarray, alphas: Sequence[float], max_iter: int = 10_000, tol: float = 1e-9
) -> np.ndarray:
    """Coefficients per alpha of  b'Sb/2 - c'b + alpha |b|_1  by coordinate descent on the moments.

    Sweeps run over the working set only; it grows until no column outside it
    violates its optimality condition.
    """
    p, out = len(c), []
    b, grad, diag = np.zeros(p), c.astype(float).copy(), np.diag(s)  # grad = c - S b
    usable = diag > 1e-14
    unit = max(float(np.max(np.abs(c))) if p else 0.0, 1e-300)
    for alpha in alphas:
        work = set(np.flatnonzero(b))
        while True:
            for sweep in range(max_iter):
                if sweep % 25 == 24 and _jump(s, c, alpha, b):
                    grad = c - s @ b
                worst = 0.0
                for j in work:
                    new = soft(grad[j] + diag[j] * b[j], alpha) / diag[j]
                    step = new - b[j]
                    if step != 0.0:
                        grad -= s[:, j] * step
                        b[j] = new
                        worst = max(worst, abs(step) * diag[j])
                if worst < tol * unit:
                    break
            late = np.flatnonzero(usable & (b == 0) & (np.abs(grad) > alpha + tol * unit))
            new_work = set(late) - work
            if not new_work:
                break
            work |= new_work
        out.append(b.copy())
    return np.array(out)


def _profile_out(s: np.ndarray, c: np.ndarray, free: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Moments of the other columns after partialling out the free ones, and the map back."""
    rest = [j for j in range(len(c)) if j not in free]
    proj = np.linalg.pinv(s[np.ix_(free, free)]) @ s[np.ix_(free, rest)]
    s2 = s[np.ix_(rest, rest)] - s[np.ix_(rest, free)] @ proj
    c2 = c[rest] - proj.T @ c[free]
    return s2, c2, proj


def _path(s: np.ndarray, c: np.ndarray, alphas, free: list[int]) -> np.ndarray:
    if not free:
        return lasso_path(s, c, alphas)
    rest = [j for j in range(len(c)) if j not in free]
    s2, c2, proj = _profile_out(s, c, free)
    inner = lasso_path(s2, c2, alphas)
    out = np.zeros((len(alphas), len(c)))
    out[:, rest] = inner
    base = np.linalg.pinv(s[np.ix_(free, free)]) @ c[free]
    out[:, free] = base - inner @ proj.T
    return out


def _scaled(m: Moments, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centred second moments per row of the scaled columns."""
    sxx, sxy, _, _, _ = m.centred()
    return sxx / np.outer(scale, scale) / m.n, sxy / scale / m.n


def _mse(m: Moments, b: np.ndarray, fit_on: Moments) -> float:
    """Mean squared error on ``m`` of slopes ``b`` whose intercept comes from ``fit_on``."""
    _, _, _, mx, my = fit_on.centred()
    v = np.concatenate([[-(my - b @ mx)], -b, [1.0]])
    return float(v @ m.a @ v / m.n)


def lasso_from_moments(
    parts: dict[int, Moments], names: Sequence[str], unpenalized: Sequence[str] = (), n_alphas: int = 100,
    eps: float = 1e-3,
) -> LassoModel:
    """Cross-validated Lasso; fold moments are all that is needed, training = total - fold."""
    if not parts:
        raise ValueError("no complete row to fit")
    whole = total(parts)
    sxx, _, _, mx, my = whole.centred()
    scale = np.sqrt(np.maximum(np.diag(sxx), 0) / whole.n)
    scale[scale < 1e-12] = 1.0
    free = [list(names).index(n) for n in unpenalized]
    s, c = _scaled(whole, mx, scale)
    lead = c if not free else _profile_out(s, c, free)[1]
    top = float(np.max(np.abs(lead))) if len(lead) else 0.0
    alphas = np.geomspace(max(top, 1e-15), max(top, 1e-15) * eps, n_alphas)
    errors = []
    for fold in parts.values():
        train = whole - fold
        if fold.n == 0 or train.n == 0:
            continue
        st, ctr = _scaled(train, mx, scale)
        errors.append([_mse(fold, b / scale, train) for b in _path(st, ctr, alphas, free)])
    cv = np.mean(errors, axis=0)
    best = int(np.argmin(cv))
    b = _path(s, c, alphas[: best + 1], free)[-1]
    return LassoModel(
        list(names), b, mx + whole.shift[:-1], scale, my + whole.shift[-1], float(alphas[best]), alphas, cv,
        int(round(whole.n)))


def lasso_cv(
    df: DataFrame, xs: Sequence[str], y: str, folds: int = 5, key: Sequence[str] = (), unpenalized: Sequence[str] = (),
    seed: int = 42,
) -> LassoModel:
    """Standardise, choose alpha by k-fold cross-validation, fit: one data pass for all folds and alphas.

    All columns are penalised unless named in ``unpenalized``.
    """
    data = kfold(df.where(F.col(y).isNotNull()).fillna(0.0, list(xs)), folds, list(key) or [*xs, y], seed)
    parts = fit_moments(data, xs, y, ["fold"])
    return lasso_from_moments({k[0]: m for k, m in parts.items()}, xs, unpenalized)


def selected_features(coefs: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Features with a coefficient above ``tol``, largest first."""
    return coefs.withColumn("abs_coefficient", F.abs("coefficient")).where(F.col("abs_coefficient") > tol).orderBy(
        F.desc("abs_coefficient"), "feature")


def lasso_path_counts(
    df: DataFrame, xs: Sequence[str], y: str, alphas: Sequence[float], controls: Sequence[str] = ()
) -> DataFrame:
    """Number of selected columns per alpha: total, concept features, controls."""
    m = fit_moments(df, xs, y)[()]
    sxx, _, _, mx, _ = m.centred()
    scale = np.sqrt(np.diag(sxx) / m.n)
    scale[scale < 1e-12] = 1.0
    s, c = _scaled(m, mx, scale)
    order = np.argsort(alphas)[::-1]
    coefs = lasso_path(s, c, [alphas[i] for i in order])
    ctrl = np.array([x in controls for x in xs])
    rows = []
    for i, b in zip(order, coefs):
        on = np.abs(b) > 0
        rows.append((float(alphas[i]), int(on.sum()), int((on & ~ctrl).sum()), int((on & ctrl).sum())))
    return df.sparkSession.createDataFrame(rows, "alpha double, n_total long, n_concept long, n_control long")


def r2_variance(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """1 - var(y - prediction) / var(y)."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), (1 - F.var_pop(F.col(y) - F.col(pred)) / F.var_pop(y)).alias("r2"))


def feature_selection(
    panel: DataFrame, outcomes: Sequence[str], concepts: Sequence[str], controls: Sequence[str] = (),
    split_year: int | None = None, folds: int = 5, min_rows: int = 100, key: Sequence[str] = (),
    years: Sequence[int] | None = None,
) -> DataFrame:
    """Lasso per outcome, optionally out of sample from ``split_year`` on; one result row per outcome.

    Fold-by-side moments are collected once per outcome and serve fitting and
    both R2 values; no row subsample is needed.
    """
    xs, rows = [*controls, *concepts], []
    for y in outcomes:
        for year in (years or [split_year]):
            data = panel.where(F.col(y).isNotNull()).fillna(0.0, xs)
            if year is not None:
                data = data.where(F.col("year").isNotNull())  # on neither side of the split
            late = F.lit(False) if year is None else F.col("year") >= year
            data = kfold(data.withColumn("_late", late), folds, list(key) or [*xs, y])
            parts = fit_moments(data, xs, y, ["_late", "fold"])
            train = {f: m for (side, f), m in parts.items() if not side}
            test = {f: m for (side, f), m in parts.items() if side}
            n_train, n_test = (sum(m.n for m in p.values()) for p in (train, test))
            if n_train + n_test < min_rows:
                continue
            if n_train < min_rows or (year is not None and n_test < min_rows):
                train, test = _merge(train, test), {}
            model = lasso_from_moments(train, xs)
            whole = total(train)
            on = [n for n, c in zip(xs, model.coef) if abs(c) > 1e-6 and n in concepts]
            rows.append((y, year, int(whole.n), int(total(test).n) if test else 0, len(on), _r2(whole, model),
                         _r2(total(test), model) if test else None, model.alpha))
    return panel.sparkSession.createDataFrame(
        rows, "outcome string, split_year int, n_train long, n_test long, n_features_selected long, r2_train double, "
        "r2_test double, alpha double")


def split_sensitivity(
    panel: DataFrame, outcome: str, concepts: Sequence[str], years: Sequence[int], controls: Sequence[str] = (),
    key: Sequence[str] = (),
) -> DataFrame:
    """The out-of-sample result for several split years."""
    return feature_selection(panel, [outcome], concepts, controls, key=key, years=years)


def _merge(a: dict, b: dict) -> dict:
    return {k: a[k] + b[k] if k in a and k in b else a.get(k, b.get(k)) for k in {*a, *b}}


def _r2(m: Moments, model: LassoModel) -> float:
    """1 - var(residual) / var(y) from moments."""
    sxx, sxy, syy, _, _ = m.centred()
    b = model.coef / model.scales
    return float(1 - (syy - 2 * b @ sxy + b @ sxx @ b) / syy)


def feature_correlations(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Correlation of each column with the outcome, from one moment pass."""
    data = df.where(F.col(y).isNotNull()).fillna(0.0, list(xs))
    m = fit_moments(data, xs, y)[()]
    sxx, sxy, syy, _, _ = m.centred()
    d = np.sqrt(np.diag(sxx) * syy)
    rows = [(x, float(c / s) if s > 0 else None) for x, c, s in zip(xs, sxy, d)]
    return df.sparkSession.createDataFrame(rows, "feature string, correlation double")
