"""Tiled moments and wide pricing against direct sums and fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingpanel.operators import moments as mo, pricing as pr, tiles
from filingpanel.operators.sampling import kfold

P, ROWS = 130, 1200  # three blocks


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(ROWS, P)) * rng.uniform(0.1, 5, P) + rng.normal(size=P)
    y = x[:, :5] @ np.array([1, -2, 0.5, 0.1, 3]) + rng.normal(size=ROWS)
    return x, y, rng.integers(2010, 2014, ROWS), rng.integers(0, 3, ROWS)


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y, year, fold = data
    rows = [(i, [float(v) for v in x[i]], float(y[i]), int(year[i]), int(fold[i])) for i in range(ROWS)]
    extra = [(ROWS, None, 1.0, 2011, 0), (ROWS + 1, [1.0] * (P - 1) + [None], 1.0, 2011, 0), (ROWS + 2, [0.0] * P, None, 2011, 0)]
    return spark.createDataFrame(rows + extra, "id long, z array<double>, y double, year int, fold int").repartition(7)


@pytest.mark.parametrize("chunk_rows, tile", [(tiles.CHUNK_ROWS, tiles.TILE), (50, 30)])
def test_blocks(frame, data, chunk_rows, tile):
    x, y, year, fold = data
    rows = tiles.wide_rows(frame.withColumn("year", F.when(F.col("year") != 2010, F.col("year"))), "z", "y", ["year", "fold"])
    width, means = tiles.width_and_means(rows)
    assert width == P + 2 and np.allclose(means, [*x.mean(0), y.mean()])
    blocks = tiles.tiled_moments(rows, ["year", "fold"], means, tile, chunk_rows)
    table = blocks.toArrow()
    assert max(len(p) for p in table["part"].to_pylist()) <= tile * tile
    a = np.column_stack([np.ones(ROWS), x, y]) - np.append(0, means)
    got = {(r["year"], r["fold"]) for r in table.select(["year", "fold"]).to_pylist()}
    assert got == {(t if t != 2010 else None, f) for t, f in zip(year.tolist(), fold.tolist())}
    for t, f in got:
        mine = (year == (t or 2010)) & (fold == f)
        own = table.filter([(r["year"], r["fold"]) == (t, f) for r in table.select(["year", "fold"]).to_pylist()])
        assert np.allclose(tiles.assembled(own, width, tile), a[mine].T @ a[mine])
    first, diagonal = tiles.total_variances(blocks, width, tile)
    assert np.allclose(first, (a.T @ a)[:, 0], atol=1e-6) and np.allclose(diagonal, np.diag(a.T @ a))


def ridge(x, y, alpha, scale):
    a, b = (x - x.mean(0)) / scale, y - y.mean()
    return np.linalg.solve(a.T @ a + alpha * np.eye(P), a.T @ b) / scale


@pytest.mark.parametrize("scaling", ["train", "all", "none"])
def test_forward_from_an_array_column(frame, data, scaling):
    x, y, year, fold = data
    got = {(r.year, r.fold): r for r in pr.pricing_forward(frame, "z", "y", alphas=(3.0,), scaling=scaling, key=["id"]).collect()}
    assert set(got) == {(t, f) for t in (2011, 2012, 2013) for f in range(3)}
    for (t, f), r in got.items():
        on = (year < t) & (fold != f)
        scale = {"train": x[on].std(0), "all": x.std(0), "none": np.ones(P)}[scaling]
        w = ridge(x[on], y[on], 3.0, scale)
        assert r.n_train == on.sum() and np.allclose(r.weights, w, rtol=1e-5, atol=1e-7)
        assert r.intercept == pytest.approx(y[on].mean() - x[on].mean(0) @ w, abs=1e-6)


def test_pooled_alpha_from_inner_folds(frame, data):
    x, y, _, fold = data
    numbers = kfold(frame.select("id"), 3, ["id"], seed=7).collect()
    inner = np.array([r.fold for r in sorted(numbers, key=lambda r: r.id)])[:ROWS]
    alphas = tuple(np.logspace(-1, 4, 12))
    got = {r.fold: r for r in pr.pricing_pooled(frame, "z", "y", alphas=alphas, key=["id"]).collect()}
    for f, r in got.items():
        on = fold != f
        scores = []
        for i in range(3):
            a, b = on & (inner != i), on & (inner == i)
            scale, out = x[on].std(0), []
            for alpha in alphas:
                w = ridge(x[a], y[a], alpha, scale)
                e = y[b] - y[a].mean() - (x[b] - x[a].mean(0)) @ w
                out.append(1 - e @ e / ((y[b] - y[b].mean()) ** 2).sum())
            scores.append(out)
        best = alphas[int(np.argmax(np.mean(scores, 0)))]
        assert r.year == pr.POOLED and r.alpha == pytest.approx(best)
        assert np.allclose(r.weights, ridge(x[on], y[on], best, x[on].std(0)), rtol=1e-5, atol=1e-7)
    assert len(got) == 3


def test_wide_equals_narrow(frame):
    names = [f"x{i}" for i in range(8)]
    df = frame.where("z IS NOT NULL").select("id", "y", "year", F.when(F.col("id") % 50 != 0, F.col("fold")).alias("fold"),
                                             *[F.col("z")[i].alias(n) for i, n in enumerate(names)])
    for fit in (pr.pricing_pooled, pr.pricing_forward):
        one, two = ({(r.year, r.fold): r for r in fit(df, names, "y", key=["id"], wide=w).collect()} for w in (False, True))
        assert set(one) == set(two) and one
        for k, r in one.items():
            assert (r.alpha, r.n_train) == (two[k].alpha, two[k].n_train)
            assert np.allclose(r.weights, two[k].weights, rtol=1e-8) and r.intercept == pytest.approx(two[k].intercept, rel=1e-8)


def test_where_a_panel_is_fitted(spark, frame):
    assert not pr._is_wide(["x"] * 300, None) and pr._is_wide(["x"] * 2390, None) and pr._is_wide("z", False)
    assert mo.MAX_COLLECT_BYTES == 1 << 30
    none = frame.limit(0)
    assert pr.pricing_pooled(none, "z", "y", key=["id"]).count() == pr.pricing_forward(none, "z", "y", key=["id"]).count() == 0
    with pytest.raises(ValueError):
        pr.pricing_pooled(frame, "z", "y")
    ragged = spark.createDataFrame([(1, [1.0], 1.0), (2, [1.0, 2.0], 1.0)], "id long, z array<double>, y double")
    with pytest.raises(ValueError):
        tiles.width_and_means(tiles.wide_rows(ragged, "z", "y", []))
