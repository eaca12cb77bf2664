"""Sources, event windows, interpretation and streaming on small fixtures."""

import datetime as dt
import hashlib
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingpanel.operators import controls as ct, eventstudy as es, interpret as ip, prepare, quality as qa, results as rs, sampling as sp
from filingpanel.operators import stability as sb, concepts as cp
from filingpanel.sources import filings, metadata, store
from filingpanel.streaming.loss_monitor import latest_status, loss_plateau_stream

DAY = dt.date(2020, 3, 1)


def day(i):
    return DAY + dt.timedelta(days=i)


def test_read_filings_from_folder_and_zip(spark, tmp_path):
    year = tmp_path / "item1" / "2020"
    year.mkdir(parents=True)
    (year / "0000001800-20-000015.txt").write_bytes(b"  Good text \xff here\n")
    (year / "0000001801-20-000016.txt").write_bytes(b" \n ")
    (year / "nohyphen.txt").write_text("other text")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for f in year.iterdir():
            z.write(f, f"item1/2020/{f.name}")
    for out in (filings.read_filings(spark, str(tmp_path / "item1"), "item1"),
                filings.read_filing_archives(spark, str(tmp_path), "item1")):
        got = {r["accession_number"]: r for r in out.collect()}
        assert set(got) == {"0000001800-20-000015", "nohyphen"}
        r = got["0000001800-20-000015"]
        assert (r["cik"], r["year"], r["text"], r["text_length"]) == (1800, 2020, "Good text  here", 15)
        assert got["nohyphen"]["cik"] is None


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("a", "item1", "x"), ("b", "item7", "y")], "accession_number string, item_type string, text string")
    store.write_by(df, str(tmp_path / "by"), "item_type", drop=["text"])
    back = spark.read.parquet(str(tmp_path / "by"))
    assert back.where("item_type = 'item7'").first()["accession_number"] == "b" and "text" not in back.columns
    for fmt in ("csv", "json"):
        store.write_result(df, str(tmp_path / fmt), fmt)
        assert getattr(spark.read, fmt)(str(tmp_path / fmt)).count() >= 2
    with pytest.raises(ValueError):
        store.write_result(df, str(tmp_path / "x"), "xml")
    emb = df.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    store.write_embeddings(emb, str(tmp_path / "emb"), ["accession_number"])
    assert store.read_embeddings(spark, str(tmp_path / "emb")).schema["embedding"].dataType.elementType.typeName() == "float"


def test_metadata_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("accession_number,cik,fiscal_year,ticker,filing_date\n109087224000040,1090872,2024,A,2024-12-20\n,5,2023,B,\n")
    df = metadata.read_metadata(spark, str(tmp_path / "m.csv"))
    out = prepare.normalize_accession(df).orderBy("cik").collect()
    assert [r["accession_number"] for r in out] == [None, "0001090872-24-000040"]


def window_case(spark):
    rng = np.random.default_rng(4)
    rets = [(p, day(int(i)), float(rng.normal()), float(rng.integers(1, 9))) for p in (1, 2)
            for i in sorted(rng.choice(200, 120, replace=False))]
    events = [(p, day(int(i))) for p in (1, 2, 3) for i in rng.choice(200, 25)]
    r = spark.createDataFrame(rets, "permno long, date date, abret double, vol double").withColumn("ret", F.col("abret") / 50)
    return rets, events, r, spark.createDataFrame(events, "permno long, filing_date date")


def test_event_windows_match_brute_force(spark):
    rets, events, r, f = window_case(spark)
    got = {(x["permno"], x["filing_date"]): x for x in es.event_outcomes(f, r).collect()}
    assert set(got) == set(events)
    for (p, d), row in got.items():
        off = {(q - d).days: (a, v) for pp, q, a, v in rets if pp == p}

        def within(lo, hi):
            return [off[i] for i in sorted(off) if lo <= i <= hi]

        for name, lo, hi in (("car_minus1_plus1", -1, 1), ("drift_30d", 2, 30), ("drift_60d", 2, 60), ("drift_90d", 2, 90)):
            w = within(lo, hi)
            assert (row[name] is None) == (not w)
            if w:
                assert row[name] == pytest.approx(sum(a for a, _ in w))
        before = within(-30, -1)
        if before and 0 in off:
            assert row["volume_ratio"] == pytest.approx(off[0][1] / np.mean([v for _, v in before]))
        else:
            assert row["volume_ratio"] is None
        around = within(-1, 1)
        if len(before) > 1 and len(around) > 1:
            assert row["volatility_ratio"] == pytest.approx(
                np.std([a for a, _ in around], ddof=1) / np.std([a for a, _ in before], ddof=1))
        else:
            assert row["volatility_ratio"] is None


def test_asof_is_strictly_before(spark):
    c = spark.createDataFrame([(1, day(0), 10.0), (1, day(5), 20.0), (2, day(3), None)], "gvkey long, datadate date, at double")
    f = spark.createDataFrame([(1, day(0)), (1, day(1)), (1, day(5)), (1, day(6)), (2, day(9)), (3, day(9)), (None, day(1))],
                              "gvkey long, filing_date date")
    got = {(r["gvkey"], r["filing_date"]): (r["datadate"], r["at"]) for r in es.asof_latest(f, c, ["at"]).collect()}
    assert got == {(1, day(0)): (None, None), (1, day(1)): (day(0), 10.0), (1, day(5)): (day(0), 10.0),
                   (1, day(6)): (day(5), 20.0), (2, day(9)): (day(3), None), (3, day(9)): (None, None),
                   (None, day(1)): (None, None)}


def test_canonical_dates_needs_a_date_column(spark):
    with pytest.raises(ValueError):
        es.canonical_dates(spark.range(1))


def test_winsorize_matches_numpy(spark):
    x = np.random.default_rng(1).normal(size=900)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(-1, None)], "id int, bm double")
    got = {r["id"]: r["bm"] for r in ct.winsorize(df, ["bm"]).collect()}
    expect = np.clip(x, np.quantile(x, 0.01), np.quantile(x, 0.99))
    assert all(got[i] == pytest.approx(v, abs=1e-12) for i, v in enumerate(expect)) and got[-1] is None


def test_low_examples_for_rare_and_dense_features(spark):
    """Feature 0 is sparse, 1 is zero in few rows, 2 in fewer than wanted, 3 is never zero."""
    n, want = 4000, 5
    rows = [(f"a{i:05d}", i % 3, "item1", f"text {i}") for i in range(n)]
    sents = spark.createDataFrame(rows, "accession_number string, sentence_id int, item_type string, text string")
    value = {0: lambda i: i % 10 == 0, 1: lambda i: i % 300 != 7, 2: lambda i: i not in (17, 1999), 3: lambda i: True}
    act = [(a, s, t, f, float(i % 997 + 1)) for i, (a, s, t, _) in enumerate(rows) for f, on in value.items() if on(i)]
    long = spark.createDataFrame(act, "accession_number string, sentence_id int, item_type string, feature_id int, value double")
    got = ip.low_examples(long, sents, [0, 1, 2, 3], n=want).collect()
    import hashlib

    dense = {f: np.array([float(i % 997 + 1) if on(i) else 0.0 for i in range(n)]) for f, on in value.items()}
    for f in value:
        h = dense[f]
        pool = np.flatnonzero(h == 0) if (h == 0).sum() >= want else np.flatnonzero(h <= np.quantile(h, 0.05))
        rank = sorted(pool, key=lambda i: hashlib.md5(f"42|{rows[i][0]}|{rows[i][1]}|item1".encode()).hexdigest())
        assert {r["text"] for r in got if r["feature_id"] == f} == {f"text {i}" for i in rank[:want]}


def test_prompts_skip_one_sided_features_and_labeller_plugs_in(spark):
    high = spark.createDataFrame([(1, 1, "x" * 300), (2, 1, "only high")], "feature_id int, example int, text string")
    low = spark.createDataFrame([(1, 1, "low")], "feature_id int, example int, text string")
    p = ip.interpretation_prompts(high, low)
    row = p.collect()
    assert [r["feature_id"] for r in row] == [1] and row[0]["high"] == "1. " + "x" * 200 + "..."
    out = ip.describe_concepts(p, lambda: lambda prompts: [str(len(t)) for t in prompts]).first()
    assert out["description"] == str(len(row[0]["prompt"]))


def test_fdr_matches_step_up_procedure(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216, 0.222, 0.251, 0.269, 0.275, 0.34]
    out = rs.fdr_bh(spark.createDataFrame([(i, v) for i, v in enumerate(p)], "feature int, p_value double")).orderBy("feature").collect()
    q, low = [0.0] * len(p), 1.0
    for i in range(len(p) - 1, -1, -1):
        low = min(low, p[i] * len(p) / (i + 1))
        q[i] = low
    assert [r["p_value_fdr"] for r in out] == pytest.approx(q)
    # largest i with p_i <= i * 0.05 / 15 is 1: 0.008 exceeds 2 * 0.05 / 15
    assert [r["significant_fdr"] for r in out] == [True] + [False] * 14


def test_replica_similarity_ignores_blocks(spark, monkeypatch):
    r = np.random.default_rng(2)
    w = r.normal(size=(3, 20, 6))
    rows = [(20, 4, i, j, [float(v) for v in w[i, j]]) for i in range(3) for j in range(20)]
    df = spark.createDataFrame(rows, "M int, k int, replica int, neuron int, w_dec array<double>")
    u = w / np.linalg.norm(w, axis=2, keepdims=True)
    expect = {(i, j, n): float((u[i, n] @ u[j].T).max()) for i in range(3) for j in range(3) if i != j for n in range(20)}
    for block in (7, 512):
        monkeypatch.setattr(sb, "_BLOCK", block)
        got = {(x["i"], x["j"], x["neuron"]): x["similarity"] for x in sb.replica_similarity(df).collect()}
        assert got.keys() == expect.keys()
        assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in expect.items())


def test_replica_similarity_is_exact_among_near_copies(spark, monkeypatch):
    """Vectors that single precision cannot tell apart, in many parts, with repeated neurons and replicas of other sizes."""
    r = np.random.default_rng(3)
    base = r.normal(size=8)
    w = [(i, j % 40, base * (1 + r.random()) + 1e-6 * r.normal(size=8)) for i, n in ((0, 60), (2, 90), (7, 1)) for j in range(n)]
    rows = [(32, 4, i, j, [float(v) for v in x]) for i, j, x in w]
    df = spark.createDataFrame(rows, "M int, k int, replica int, neuron int, w_dec array<double>")
    expect = {}
    for i, n, x in w:
        for j in {0, 2, 7} - {i}:
            s = max(float(x @ y) / ((np.linalg.norm(x) + 1e-8) * (np.linalg.norm(y) + 1e-8)) for other, _, y in w if other == j)
            expect[i, j, n] = max(s, expect.get((i, j, n), -1))
    for block, values in ((512, 1 << 21), (16, 1 << 21), (16, 100)):
        monkeypatch.setattr(sb, "_BLOCK", block)
        monkeypatch.setattr(sb, "_VALUES", values)
        got = {(x["i"], x["j"], x["neuron"]): x["similarity"] for x in sb.replica_similarity(df).collect()}
        assert got.keys() == expect.keys()
        assert all(abs(got[k] - v) < 1e-14 for k, v in expect.items())


def test_replica_similarity_of_null_vectors_and_a_single_replica(spark):
    """As in SQL: what is null matches nothing and has no similarity; NaN is passed on; no replica matches itself."""
    nan = float("nan")
    rows = [(8, 4, 0, 0, [1.0, 0.0]), (8, 4, 0, 1, None), (8, 4, 1, 0, None), (8, 4, 1, 1, [0.6, 0.8]), (8, 4, 1, None, [0.0, 2.0]),
            (8, 4, None, 5, [1.0, 0.0]), (9, 4, 0, 0, [1.0]), (10, 4, 0, 0, [1.0]), (10, 4, 1, 0, None), (11, 4, 0, 0, [nan]),
            (11, 4, 0, 1, [1.0]), (11, 4, 1, 0, [1.0])]
    df = spark.createDataFrame(rows, "M int, k int, replica int, neuron int, w_dec array<double>")
    got = {(x["M"], x["i"], x["neuron"]): x["similarity"] for x in sb.replica_similarity(df).collect()}
    some = {k: v for k, v in got.items() if v is not None and v == v}
    assert some == pytest.approx({(8, 0, 0): 0.6, (8, 1, 1): 0.6, (8, 1, None): 0.0, (11, 0, 1): 1.0}, abs=1e-7)
    assert {k for k, v in got.items() if v is None} == {(8, 0, 1), (8, 1, 0), (10, 0, 0), (10, 1, 0)}
    assert {k for k, v in got.items() if v is not None and v != v} == {(11, 0, 0), (11, 1, 0)}


def test_replicas_meet_in_many_tasks_and_once(spark):
    """The work does not depend on the number of replicas, and the summary does not repeat it for each of its figures."""
    n = 9000
    df = spark.range(2 * n).select(
        F.lit(64).alias("M"), F.lit(4).alias("k"), (F.col("id") % 2).cast("int").alias("replica"), F.floor(F.col("id") / 2).cast("int").alias("neuron"),
        F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.sin(F.col("id") * i)).alias("w_dec"))
    pairs = sb._pairs_of_parts(df)
    tasks = pairs.groupBy(*sb._PAIR).agg(F.count_if("left").alias("x"), F.count_if(~F.col("left")).alias("y")).collect()
    assert len(tasks) == 25 and sum(t["x"] * t["y"] for t in tasks) == n * n
    assert max(max(t["x"], t["y"]) for t in tasks) < 2100
    out = sb.stability_summary(df, sb.replica_similarity(df), 0.3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "InPandas" not in plan
    assert out.first()["n_features_total"] == n


def test_stable_activations_need_a_stable_feature(spark):
    models = spark.createDataFrame([], "M int, k int, replica int, neuron int, w_enc array<double>, b double, w_dec array<double>")
    with pytest.raises(ValueError):
        cp.stable_activations(spark.range(1), models, models.select("M", "k", F.lit(0).alias("neuron_idx")), ["id"])


def test_embedding_is_unit_length_and_pluggable(spark):
    df = spark.createDataFrame([(1, "Some words here"), (2, "some words HERE"), (3, "other")], "id int, text string").repartition(3)
    e = {r["id"]: np.array(r["embedding"]) for r in cp.embed(df, dim=32).collect()}
    assert np.allclose(np.linalg.norm(list(e.values()), axis=1), 1, atol=1e-6)
    assert np.array_equal(e[1], e[2]) and not np.array_equal(e[1], e[3])
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "word"), (5, "x " * 20000)], "id int, text string")
    e = {r["id"]: np.array(r["embedding"]) for r in cp.embed(odd, dim=16).collect()}
    assert all(len(x) == 16 for x in e.values()) and not any(e[i].any() for i in (1, 2, 3))
    assert sorted(np.abs(e[4])) == [0] * 15 + [1] and np.linalg.norm(e[5]) == pytest.approx(1)
    plan = cp.embed(spark.range(3).select(F.col("id").cast("string").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Exchange" not in plan
    fixed = cp.embed(df, lambda: lambda texts: np.array([[3.0, 4.0]] * len(texts))).first()["embedding"]
    assert fixed == pytest.approx([0.6, 0.8])


def test_hashed_counts_take_one_number_per_gram(spark):
    """One conversion per token and pair and a sort by natural order; values against MD5 in Python, also of few places."""
    texts = [None, "", "One", "a b  A b", "x " * 300 + "y", "\u00e9t\u00e9 \u00c9T\u00c9\u2003z"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for dim in (1, 7, 64, 384):
        out = df.select("id", cp.hashed_counts(F.col("text"), dim).alias("n"))
        for row in out.collect():
            words, want = (texts[row["id"]] or "").lower().split(), [0] * dim
            for gram in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
                h = hashlib.md5(gram.encode()).hexdigest()
                want[int(h[:8], 16) % dim] += -1 if int(h[8], 16) % 2 else 1
            assert row["n"] == want
    plan = spark.range(1).select(cp.hashed_counts(F.col("id").cast("string"), 64).alias("n"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("conv(") == 2 and "array_sort(" not in plan


def test_sampler_is_independent_of_partitions(spark):
    df = spark.range(3000).select(
        F.concat(F.lit("f"), F.floor(F.col("id") / 10)).alias("accession_number"), F.lit("item1").alias("item_type"),
        (F.col("id") % 10).alias("sentence_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 17).alias("cik"),
        (2000 + F.col("id") % 4).alias("year"))
    runs = [sorted(map(tuple, sp.stratified_sample(df.repartition(p), 20, 60, 100).collect())) for p in (1, 11)]
    assert runs[0] == runs[1] and runs[0]


def test_alignment(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, c string")
    b = spark.createDataFrame([(1, "x"), (2, "Y"), (4, "w")], "k int, c string")
    got = {(r["state"], r["columns"]): r["n"] for r in qa.check_alignment(a, b, ["k"], ["c"]).collect()}
    assert got == {("differs", "c"): 1, ("first only", ""): 1, ("second only", ""): 1}


def test_loss_stream_follows_a_growing_log(spark, tmp_path):
    src, out = tmp_path / "log", tmp_path / "out"
    src.mkdir()
    status = None
    for part in range(2):
        lines = "".join(f"r,{i},{1.0 / (i + 1) if part == 0 else 0.04}\n" for i in range(part * 15, part * 15 + 15))
        (src / f"{part}.csv").write_text(lines)
        log = spark.readStream.schema("run string, step long, loss double").csv(str(src))
        loss_plateau_stream(log, str(out), str(tmp_path / "ck"), available_now=True).awaitTermination()
        status = latest_status(spark, str(out)).first()
        assert status["n_points"] == 15 * (part + 1)
        assert (status["improvement"] is None) == (part == 0)
    loss = [1.0 / (i + 1) for i in range(15)] + [0.04] * 15
    assert status["improvement"] == pytest.approx(1 - np.mean(loss[-10:]) / np.mean(loss[-20:-10]))
