"""Linear models and the encoder against direct numpy work and optimality conditions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingpanel.operators import concepts as cp, moments as mo, pricing as pr, regression as rg, training as tr
from filingpanel.operators.sampling import firm_folds


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(3)
    n = 1500
    x = r.normal(size=(n, 6)) * [1, 2, 5, 0.1, 1, 1] + [0, 10, -3, 1000, 0, 2]
    x[:, 4] = x[:, 0] * 0.9 + 0.1 * x[:, 4]
    firm = np.where(np.arange(n) % 3 == 0, 0, r.integers(1, 60, n))  # firm 0 holds a third
    y = 0.5 * x[:, 0] - 0.2 * x[:, 1] + 0.05 * x[:, 2] + r.normal(size=n) * (1 + (firm == 0)) + 7
    return x, y, firm, 2000 + r.integers(0, 6, n)


XS = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y, firm, year = data
    rows = [(i, int(f), int(t), float(v), *map(float, a)) for i, (f, t, v, a) in enumerate(zip(firm, year, y, x))]
    return spark.createDataFrame(rows, "id long, cik long, year int, y double, " + ", ".join(f"{c} double" for c in XS)).repartition(6).cache()


def design(x):
    return np.column_stack([np.ones(len(x)), x])


def test_moments_do_not_depend_on_partitions(frame):
    a = mo.fit_moments(frame, XS, "y", ["year"])
    b = mo.fit_moments(frame.repartition(1), XS, "y", ["year"])
    assert a.keys() == b.keys()
    for k in a:
        assert np.allclose(a[k].a, b[k].a, rtol=1e-10)


@pytest.mark.parametrize("cov", ["HC1", "classic", "cluster"])
def test_ols(frame, data, cov):
    x, y, firm, _ = data
    fit = rg.ols(frame, "y", XS, cov=cov, cluster="cik" if cov == "cluster" else None)
    d = design(x)
    b = np.linalg.lstsq(d, y, rcond=None)[0]
    e, n, k = y - d @ b, len(y), d.shape[1]
    inv = np.linalg.inv(d.T @ d)
    if cov == "HC1":
        v = inv @ (d.T * e ** 2) @ d @ inv * n / (n - k)
    elif cov == "classic":
        v = inv * (e @ e) / (n - k)
    else:
        s = np.array([(d[firm == g] * e[firm == g][:, None]).sum(0) for g in np.unique(firm)])
        g = len(s)
        v = inv @ s.T @ s @ inv * g / (g - 1) * (n - 1) / (n - k)
    assert np.allclose(fit.coef, b, rtol=1e-6)
    assert np.allclose(fit.se, np.sqrt(np.diag(v)), rtol=1e-5)
    assert fit.r2 == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum())


def test_moments_of_many_clusters_are_not_made_one_by_one(spark):
    """Few columns: built-in sums, no Python; the same rows as the matrix products, also with more columns and without complete rows."""
    rows = [(i, None if i % 11 == 0 else i // 3, i % 5 / 3, None if i % 7 == 0 else float(i % 13), float("nan") if i % 17 == 0 else i % 4 * 0.5) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, cik long, y double, x1 double, x2 double").repartition(5)
    wide = df.select("cik", "y", "x1", *[(F.col("x2") * i + F.col("id") % (i + 2)).alias(f"x{i}") for i in range(2, 9)])

    def table(t):
        return {(r["cik"], r["i"]): np.array(r["row"]) for r in t.collect()}

    for frame, xs in ((df, ["x1", "x2"]), (df, ["x1"]), (wide, [f"x{i}" for i in range(1, 9)])):
        shift = np.arange(len(xs) + 1) / 4
        few = mo.moments_of_many(frame, xs, "y", ["cik"], shift)
        got, want = table(few), table(mo.moments(frame, xs, "y", ["cik"], shift))
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12, atol=1e-9) for k in want)
        assert mo.moments_of_many(frame.limit(0), xs, "y", ["cik"], shift).count() == 0
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert ("InArrow" in plan) == (len(xs) + 2 > mo.SUM_COLUMNS)


def test_nested_f_and_joint_test_agree_for_classic_errors(spark, frame):
    cmp = rg.compare_models(frame, ["y"], XS[:2], XS[2:]).first()
    joint = rg.joint_f_test(spark, rg.ols(frame, "y", XS, cov="classic"), XS[2:]).first()
    assert cmp["f_stat"] == pytest.approx(joint["f_statistic"], rel=1e-6)
    assert cmp["f_pval"] == pytest.approx(joint["p_value"], abs=1e-9)


@pytest.mark.parametrize("free", [[], ["x1"]])
def test_lasso_meets_its_optimality_conditions(frame, data, free):
    x, y, _, _ = data
    m = rg.lasso_cv(frame, XS, "y", key=["id"], unpenalized=free)
    z = (x - x.mean(0)) / x.std(0)
    r = (y - y.mean()) - z @ m.coef
    grad = z.T @ r / len(y)
    for j, name in enumerate(XS):
        if name in free:
            assert abs(grad[j]) < 1e-6
        elif m.coef[j] != 0:
            assert grad[j] == pytest.approx(m.alpha * np.sign(m.coef[j]), abs=1e-6)
        else:
            assert abs(grad[j]) <= m.alpha + 1e-6
    assert m.alphas[0] >= m.alpha >= m.alphas[-1]
    pred = m.predict(frame).select("id", "prediction").orderBy("id").toPandas()["prediction"].to_numpy()
    assert np.allclose(pred, y.mean() + z @ m.coef, atol=1e-6)


def test_lasso_folds_equal_a_direct_fit(frame):
    """Cross-validation errors from moments equal those from the rows."""
    folds = rg.kfold(frame, 5, ["id"]).toPandas().sort_values("id")
    x, y, f = folds[XS].to_numpy(), folds["y"].to_numpy(), folds["fold"].to_numpy()
    m = rg.lasso_cv(frame, XS, "y", key=["id"])
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / sd
    errors = []
    for k in range(5):
        a, b = z[f != k], y[f != k]
        ac, bc = a - a.mean(0), b - b.mean()
        path = rg.lasso_path(ac.T @ ac / len(b), ac.T @ bc / len(b), m.alphas)
        errors.append([np.mean((y[f == k] - b.mean() - (z[f == k] - a.mean(0)) @ w) ** 2) for w in path])
    assert np.allclose(np.mean(errors, 0), m.cv_mse, rtol=1e-6)


@pytest.mark.parametrize("scaling", ["train", "all", "none"])
def test_pricing_forward_matches_direct_ridge(frame, data, scaling):
    x, y, _, year = data
    df = firm_folds(frame, 5)
    fold = df.select("id", "fold").orderBy("id").toPandas()["fold"].to_numpy()
    out = pr.pricing_forward(df, XS, "y", alphas=(3.0,), scaling=scaling, key=["id"]).collect()
    assert len(out) == 25
    for r in out:
        t = (year < r["year"]) & (fold != r["fold"])
        a, b = x[t] - x[t].mean(0), y[t] - y[t].mean()
        s = {"train": x[t].std(0), "all": x.std(0), "none": np.ones(6)}[scaling]
        w = np.linalg.solve((a / s).T @ (a / s) + 3.0 * np.eye(6), (a / s).T @ b) / s
        assert np.allclose(r["weights"], w, rtol=1e-5, atol=1e-8)
        assert r["n_train"] == t.sum()


def test_pricing_alpha_is_the_best_of_the_inner_folds(frame):
    df = firm_folds(frame, 5)
    one = {r["fold"]: r["alpha"] for r in pr.pricing_pooled(df, XS, "y", key=["id"]).collect()}
    again = {r["fold"]: r["alpha"] for r in pr.pricing_pooled(df.repartition(3), XS, "y", key=["id"]).collect()}
    assert one == again and len(one) == 5


def test_decomposition_is_orthogonal(frame):
    df = firm_folds(frame, 5).withColumn("z", F.array(*XS))
    w = pr.pricing_pooled(df, XS, "y", alphas=(1.0,), key=["id"])
    out = pr.decompose(df, w)
    assert pr.check_decomposition(out).first()["ok"]
    worst = out.select(F.max(F.abs(F.aggregate(
        F.zip_with("z_on", "z_perp", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))).alias("m")).first()["m"]
    assert worst < 1e-6


# ---------------------------------------------------------------- encoder


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(9)
    base = r.normal(size=(8, 12))
    x = np.stack([base[i % 8] * r.uniform(0.5, 1) + base[(i * 3) % 8] * 0.3 + 0.05 * r.normal(size=12) for i in range(600)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(f"a{i // 6}", i % 6, "item1", [float(v) for v in row]) for i, row in enumerate(x)]
    return x, spark.createDataFrame(rows, "accession_number string, sentence_id int, item_type string, embedding array<float>")


KEY = ["accession_number", "sentence_id", "item_type"]


@pytest.mark.parametrize("k", [None, 1, 3, 16, 40])
def test_encoder_transform(vectors, k):
    x, df = vectors
    w = cp.closed_form_weights(16, 12)
    z = np.maximum(x.astype(np.float32).astype(float) @ w.w_enc.T, 0)
    if k is not None and k < 16:
        cut = np.sort(z, axis=1)[:, -k][:, None]
        z = np.where(z >= cut, z, 0)
    for parts in (1, 5):
        out = cp.KSparseEncoderModel(w, k).transform(df.repartition(parts)).collect()
        for r in out:
            i = int(r["accession_number"][1:]) * 6 + r["sentence_id"]
            dense = np.zeros(16)
            for a in r["activation"]:
                dense[a["feature_id"]] = a["value"]
            assert np.allclose(dense, z[i], atol=1e-9)


def test_encoder_keep_is_taken_after_top_k(vectors):
    _, df = vectors
    w = cp.closed_form_weights(16, 12)
    full = cp.to_long(cp.KSparseEncoderModel(w, 3).transform(df), KEY).where("feature_id in (2, 5)")
    kept = cp.to_long(cp.KSparseEncoderModel(w, 3, keep=[5, 2]).transform(df), KEY)
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, kept.collect()))


def test_gradients_match_finite_differences():
    r = np.random.default_rng(0)
    w, x = tr.initial(7, 4, 1), r.normal(size=(5, 4))
    _, grads = tr.gradients(x, w, 3)
    params = [w.w_enc, w.b, w.w_dec, w.c]
    for p, g in zip(params, grads):
        it = np.nditer(p, flags=["multi_index"])
        for _ in it:
            i = it.multi_index
            old = p[i]
            p[i] = old + 1e-6
            up = tr.gradients(x, w, 3)[0]
            p[i] = old - 1e-6
            down = tr.gradients(x, w, 3)[0]
            p[i] = old
            assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_training_lowers_the_loss_and_is_repeatable(vectors):
    _, df = vectors
    fit = [tr.KSparseEncoder(24, 4, 1e-2, 5, 32, shards=3).fit(df.repartition(p), KEY) for p in (2, 9)]
    losses = [r["loss"] for r in fit[0].loss_log.orderBy("epoch").collect()]
    assert losses[-1] < 0.5 * losses[0]
    assert np.array_equal(fit[0].weights.w_enc, fit[1].weights.w_enc)


def test_training_does_not_follow_the_cluster(spark, vectors):
    """The same bits under other partitions and numbers of shuffle tasks; the shards are those of the data."""
    _, df = vectors
    fits = []
    for tasks in ("2", "4", "8", "33"):
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        try:
            models, log = tr.fit_ensemble(df.repartition(int(tasks)), KEY, [9], [3], 2, epochs=2, batch=16)
            fits.append((sorted((r.replica, r.neuron, r.w_enc, r.b, r.w_dec) for r in models.collect()), sorted(map(tuple, log.collect()))))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert all(f == fits[0] for f in fits[1:]) and len(fits[0][0]) == 18
    data, _ = tr._prepare(df, KEY, "embedding", tr.SHARDS, F.array(F.lit(True)))
    assert data.select("_shard").distinct().count() == tr.SHARDS


def test_given_start_and_no_rows(vectors):
    _, df = vectors
    w = tr.initial(5, 12, 9)
    model = tr.KSparseEncoder(5, 2, 0.0, 1, 64, shards=4, start=w).fit(df, KEY)
    assert all(np.allclose(a, b) for a, b in ((model.weights.w_enc, w.w_enc), (model.weights.b, w.b), (model.weights.w_dec, w.w_dec), (model.weights.c, w.c)))
    with pytest.raises(ValueError):
        tr.KSparseEncoder(5, 2).fit(df.limit(0), KEY)


def test_one_shard_equals_plain_adam(vectors):
    import hashlib

    x, df = vectors
    model = tr.KSparseEncoder(10, 3, 1e-2, 2, 50, seed=5, shards=1).fit(df, KEY)
    state = tr.AdamState.of(tr.initial(10, 12, 5))
    keys = [f"a{i // 6}|{i % 6}|item1" for i in range(len(x))]
    rows = x.astype(np.float32).astype(float)
    for epoch in range(2):
        order = sorted(range(len(x)), key=lambda i: hashlib.md5(f"{5 + epoch}|{keys[i]}".encode()).hexdigest())
        for s in range(0, len(x), 50):
            state.update(tr.gradients(rows[order[s:s + 50]], state.weights, 3)[1], 1e-2)
    assert np.allclose(model.weights.w_enc, state.params[0], atol=1e-9)


def test_ensemble_table(vectors):
    _, df = vectors
    models, log = tr.fit_ensemble(df, KEY, [8, 12], [2, 3], 2, subset="M8", epochs=2, batch=64, shards=2)
    assert models.groupBy("M", "k", "replica").count().count() == 4
    assert log.count() == 8
    w = cp.load_weights(models, 8, 2, 1)
    assert w.w_enc.shape == (8, 12)
    with pytest.raises(ValueError):
        tr.fit_ensemble(df, KEY, [8], [2], 2, subset="M9")


def test_membership_is_a_sample_without_replacement(vectors):
    _, df = vectors
    m = tr.replica_membership(df, [0, 1, 2], 0.8).toPandas()["_member"]
    assert [sum(v[i] for v in m) for i in range(3)] == [80, 80, 80]


def test_no_change_between_filings_without_firm(spark):
    rows = [(None, "item1", f"2020-01-0{i}", f"a{i}", [float(i), 1.0]) for i in range(1, 4)]
    rows += [(7, None, "2020-02-01", "b", [1.0, 1.0]), (7, None, "2020-03-01", "c", [2.0, 1.0])]
    rows += [(8, "item1", "2020-02-01", "d", [1.0, 1.0]), (8, "item1", "2020-03-01", "e", [4.0, 1.0])]
    df = spark.createDataFrame(rows, "cik long, item_type string, filing_date string, accession_number string, z array<double>").withColumn(
        "filing_date", F.to_date("filing_date"))
    got = {r.accession_number: r.delta_z for r in pr.firm_diff(df).collect()}
    assert {k: v for k, v in got.items() if v is not None} == {"e": [3.0, 0.0]}


def test_null_years_are_on_neither_side_of_a_split(spark):
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 4 == 0 else 2000 + i % 10, float(rng.normal()), float(rng.normal())) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, year int, y double, x1 double")
    r = rg.feature_selection(df, ["y"], ["x1"], split_year=2005, key=["id"]).first()
    assert (r.n_train, r.n_test) == (sum(1 for x in rows if x[1] and x[1] < 2005), sum(1 for x in rows if x[1] and x[1] >= 2005))
