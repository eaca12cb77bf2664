"""Building blocks against brute force, with hot keys and different partitionings."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingpanel.functions import quantiles, sampling, tails, text
from filingpanel.functions.order import carried_lag, global_index, running_min_from_end, running_total


def skewed(n=6000, seed=1):
    """(key, value): key 'hot' holds a third of the rows."""
    r = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"k{r.randrange(40)}", r.choice([r.random(), round(r.random(), 1)]), i) for i in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(skewed(), "k string, x double, id long").repartition(7)


@pytest.mark.parametrize("n", [1, 2, 11, 12, 500, 30_000])
def test_exact_quantiles_match_numpy(spark, n):
    r = np.random.default_rng(n)
    x = np.where(r.random(n) < 0.3, np.round(r.normal(size=n), 1), r.normal(size=n))
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    qs = {"a": 0.01, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.9, "f": 0.99, "g": 0.0, "h": 1.0}
    got = quantiles.exact_quantiles(df, "x", qs).first()
    for name, q in qs.items():
        assert got[name] == pytest.approx(np.quantile(x, q), abs=1e-12)


def test_exact_quantiles_by_group(frame):
    data = skewed()
    got = {r["k"]: r["m"] for r in quantiles.exact_quantiles(frame, "x", {"m": 0.37}, ["k"]).collect()}
    for k in {d[0] for d in data}:
        assert got[k] == pytest.approx(np.quantile([d[1] for d in data if d[0] == k], 0.37), abs=1e-12)


def test_sparse_quantile_counts_zeros(spark):
    n, r = 25_000, np.random.default_rng(5)
    share = {0: 0.95, 1: 0.5, 2: 0.11, 3: 0.02}
    dense = {f: np.where(r.random(n) < s, r.random(n), 0.0) for f, s in share.items()}
    long = spark.createDataFrame(
        [(f, float(v)) for f, a in dense.items() for v in a if v > 0], "feature_id int, value double")
    for q in (0.05, 0.5, 0.9):
        out = quantiles.sparse_quantile(long, spark.range(n), "feature_id", "value", q, "t").collect()
        for row in out:
            assert row["t"] == pytest.approx(np.quantile(dense[row["feature_id"]], q), abs=1e-12)


def test_global_index_and_running(spark, frame):
    data = sorted(skewed(), key=lambda d: (d[0], d[2]))
    got = {r["id"]: r["pos"] for r in global_index(frame, ["k", "id"], "pos").collect()}
    assert got == {d[2]: i for i, d in enumerate(data)}
    total, expect = 0.0, {}
    for d in data:
        total += d[1]
        expect[d[2]] = total
    run = {r["id"]: r["s"] for r in running_total(frame, ["k", "id"], "x", "s").collect()}
    assert all(run[i] == pytest.approx(v) for i, v in expect.items())
    low, expect = float("inf"), {}
    for d in reversed(data):
        low = min(low, d[1])
        expect[d[2]] = low
    back = {r["id"]: r["m"] for r in running_min_from_end(frame, ["k", "id"], F.col("x"), "m").collect()}
    assert back == expect


def test_carried_lag_equals_plain_lag(frame):
    out = carried_lag(frame, ["k"], F.floor(F.col("id") / 500), ["id"], ["x"]).collect()
    last, expect = {}, {}
    for k, x, i in sorted(skewed(), key=lambda d: d[2]):
        expect[i] = last.get(k)
        last[k] = x
    assert {r["id"]: r["prev_x"] for r in out} == expect
    assert all(r["prev_exists"] == (expect[r["id"]] is not None) for r in out)


def md5(*parts):
    return hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()


@pytest.mark.parametrize("parts", [1, 13])
def test_lowest_ranked_and_position(frame, parts):
    order = sorted((d[2] for d in skewed()), key=lambda i: md5(42, i))
    df, rank = frame.repartition(parts), sampling.hash_rank(42, "id")
    for n in (0, 1, 777, 10_000):
        got = {r["id"] for r in sampling.lowest_ranked(df, n, rank).collect()}
        assert got == set(order[:n])
    pos = {r["id"]: r["p"] for r in sampling.hash_position(df, rank, "p").collect()}
    assert pos == {i: p for p, i in enumerate(order)}


@pytest.mark.parametrize("salt", [0, 1, 2])
def test_cap_per_group_with_hot_key(frame, salt):
    got = sampling.cap_per_group(frame, ["k"], 25, sampling.hash_rank(42, "id"), salt_digits=salt).collect()
    groups = {}
    for k, _, i in skewed():
        groups.setdefault(k, []).append(i)
    expect = {i for ids in groups.values() for i in sorted(ids, key=lambda i: md5(42, i))[:25]}
    assert {r["id"] for r in got} == expect


def test_null_group_has_its_own_cap(spark):
    df = spark.range(300).select(F.when(F.col("id") % 3 != 0, F.lit("a")).alias("k"), "id")
    for n, null_cap in ((10, 4), (4, 10)):
        got = sampling.cap_per_group(df, ["k"], n, sampling.hash_rank(1, "id"), null_cap=null_cap)
        counts = {r["k"]: r["count"] for r in got.groupBy("k").count().collect()}
        assert counts == {"a": n, None: null_cap}


TEXTS = [
    "First sentence is here now. Second one follows it!  Third asks why?\nFourth ends",
    "One two three\u0085four\x1cfive  six.", "No capital after. the dot here is kept together", "", "  ",
    "12345678901234567890 1234. Another Sentence 42 with ÉCOLE and Über words.",
    "11111111111111111111111. A sentence that is long enough to stay.　Yet ANOTHER one is here.",
]


def test_tokens_and_sentences_match_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    for r in df.select("i", text.tokens(F.col("t")).alias("w"), text.sentences(F.col("t")).alias("s")).collect():
        t = TEXTS[r["i"]]
        assert r["w"] == t.split()
        parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+(?=[A-Z])", t)]
        assert r["s"] == [p for p in parts if len(p) >= 20 and not p.isdigit()]


def test_token_counters(spark):
    w = "A1 b É Éa ab² CD 3".split()
    df = spark.createDataFrame([(w,)], "w array<string>")
    got = df.select(text.numeric_tokens(F.col("w")).alias("n"), text.capitalised_tokens(F.col("w")).alias("c")).first()
    assert got["n"] == sum(any(ch.isdigit() for ch in x) for x in w)
    assert got["c"] == sum(x[0].isupper() and len(x) > 1 for x in w)


def test_tails():
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert tails.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.f_upper(1.57, 30, 33391) == pytest.approx(0.0244, abs=2e-4)
    assert tails.f_upper(4.0, 1, 10) == pytest.approx(tails.t_two_sided(2.0, 10), abs=1e-12)
    assert tails.f_upper(3.0, 2, 4) == pytest.approx((1 + 2 * 3.0 / 4) ** -2, abs=1e-12)
