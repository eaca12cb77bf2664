"""The Lasso path: optimality at and between knots, against coordinate descent and a direct search over alpha."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingpanel.operators import homotopy as hy, regression as rg


def moments(x, y):
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    return z.T @ z / len(y), z.T @ (y - y.mean()) / len(y)


def design(seed, n=200, p=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) @ (np.eye(p) + 0.7 * rng.normal(size=(p, p)))  # correlated: columns leave, too
    return x, x @ rng.normal(size=p) * rng.integers(0, 2) + rng.normal(size=n) * 2 + x[:, 0] - 2 * x[:, 3]


def holds(s, c, alpha, b, free=(), tol=1e-8):
    grad, unit = c - s @ b, np.abs(c).max()
    for j in range(len(c)):
        if j in free:
            assert abs(grad[j]) < tol * unit
        elif abs(b[j]) > 1e-11 * unit:
            assert abs(grad[j] - alpha * np.sign(b[j])) < tol * unit
        else:
            assert abs(grad[j]) <= alpha + tol * unit


@pytest.mark.parametrize("seed", range(8))
def test_optimality_at_and_between_knots(seed):
    s, c = moments(*design(seed))
    found = hy.path(s, c)
    assert np.all(np.diff(found.alphas) <= 1e-15) and found.alphas[-1] == 0 and len(found.changes) == len(found.alphas)
    assert np.allclose(found.coefs[-1], np.linalg.solve(s, c), rtol=1e-6, atol=1e-9)
    on = set()
    for k, change in enumerate(found.changes):
        holds(s, c, found.alphas[k], found.coefs[k])
        if change:
            (on.add if change[1] else on.remove)(change[0])
    assert on == set(range(len(c)))
    for alpha in np.geomspace(found.alphas[0], found.alphas[0] * 1e-4, 50):
        holds(s, c, alpha, found.at(alpha))
    alphas = np.geomspace(found.alphas[0], found.alphas[0] * 1e-3, 30)
    assert np.allclose(rg.lasso_path(s, c, alphas), [found.at(a) for a in alphas], atol=1e-6)


def test_columns_leave():
    assert any(change and not change[1] for seed in range(8) for change in hy.path(*moments(*design(seed))).changes)


def test_columns_without_penalty():
    s, c = moments(*design(3))
    found = hy.path(s, c, [2, 5])
    for k in range(len(found.alphas)):
        holds(s, c, found.alphas[k], found.coefs[k], (2, 5))
    assert np.allclose(found.at(1e9)[[2, 5]], np.linalg.solve(s[np.ix_([2, 5], [2, 5])], c[[2, 5]]))


def test_constant_and_dependent_columns():
    x, y = design(1, p=4)
    x = np.column_stack([x, x[:, 0], x[:, 1] - x[:, 2], np.ones(len(y))])
    s, c = moments(x, y)
    found = hy.path(s, c)
    for k in range(len(found.alphas)):
        holds(s, c, found.alphas[k], found.coefs[k])
    assert np.all(found.coefs[:, 6] == 0) and np.count_nonzero(found.coefs[-1]) <= 4
    nothing = hy.path(np.zeros((2, 2)), np.zeros(2))
    assert nothing.alphas.tolist() == [0] and nothing.changes == [None]


def test_table_and_cross_validation(spark):
    x, y = design(6, 400, 5)
    names = [f"x{i}" for i in range(5)]
    rows = [(i, float(v), *map(float, a)) for i, (v, a) in enumerate(zip(y, x))] + [(999, None, *[1.0] * 5)]
    df = spark.createDataFrame(rows, "id long, y double, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    knots = hy.lasso_knots(df.where("y IS NOT NULL"), names, "y").orderBy("step").collect()
    direct = hy.path(*moments(x, y))
    assert np.allclose([r.alpha for r in knots], direct.alphas) and knots[-1].change is None
    for r, b in zip(knots, direct.coefs):
        assert np.allclose([r.coefficients.get(n, 0.0) for n in names], b, atol=1e-9)
    exact, grid = hy.lasso_cv_knots(df, names, "y", key=["id"]), rg.lasso_cv(df, names, "y", key=["id"])
    assert exact.cv_mse.min() >= 0 and abs(exact.alpha - grid.alpha) < 0.1 * grid.alphas[0]
    z = (x - x.mean(0)) / x.std(0)
    holds(z.T @ z / len(y), z.T @ (y - y.mean()) / len(y), exact.alpha, exact.coef)
    # no alpha of a fine grid does better
    folds = rg.kfold(df.where(F.col("y").isNotNull()), 5, ["id"]).toPandas().sort_values("id")
    f = folds["fold"].to_numpy()

    def error(alpha):
        out = []
        for k in range(5):
            a, b = z[f != k], y[f != k]
            w = hy.path((a - a.mean(0)).T @ (a - a.mean(0)) / len(b), (a - a.mean(0)).T @ (b - b.mean()) / len(b)).at(alpha)
            out.append(np.mean((y[f == k] - b.mean() - (z[f == k] - a.mean(0)) @ w) ** 2))
        return np.mean(out)

    best = error(exact.alpha)
    assert all(error(a) >= best - 1e-9 for a in np.linspace(0, grid.alphas[0], 200))
    pred = exact.predict(df.where("y IS NOT NULL")).orderBy("id").toPandas()["prediction"].to_numpy()
    assert np.allclose(pred, y.mean() + z @ exact.coef, atol=1e-6)
    assert hy.lasso_knots(df.limit(0), names, "y").count() == 0
