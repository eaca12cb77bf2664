"""The walk through hash ranges that finds sentences without activation."""

import hashlib

import pytest
from pyspark.sql import functions as F

from filingpanel.functions import durable as du
from filingpanel.functions.sampling import hash_rank
from filingpanel.operators import interpret as ip
from filingpanel.operators.textscore import SENTENCE_KEY

N = 6000


@pytest.fixture(scope="module")
def tables(spark):
    sents = spark.range(N).select(F.concat(F.lit("a"), F.col("id") % 100).alias("accession_number"), (F.col("id") / 100).cast("int").alias("sentence_id"),
                                  F.lit("item1").alias("item_type"), F.concat(F.lit("text "), "id").alias("text"), "id").repartition(5)
    # feature 0 is on in a third, 1 nowhere, 2 in all but thirty, 3 in all, 4 in all but five
    on = F.array(F.when(F.col("id") % 3 == 0, 0), F.when(F.col("id") % 200 != 0, 2), F.lit(3), F.when(F.col("id") % 1200 != 7, 4))
    act = sents.select(*SENTENCE_KEY, F.explode(F.filter(on, lambda f: f.isNotNull())).alias("feature_id"), F.lit(1.0).alias("value"))
    return sents, act


def key_of(i):
    return f"a{i % 100}|{i // 100}|item1"


def zeros_of(f):
    off = {0: lambda i: i % 3 != 0, 1: lambda i: True, 2: lambda i: i % 200 == 0, 3: lambda i: False, 4: lambda i: i % 1200 == 7}[f]
    return [i for i in range(N) if off(i)]


def lowest(f, n, seed=42):
    return sorted(zeros_of(f), key=lambda i: hashlib.md5(f"{seed}|{key_of(i)}".encode()).hexdigest())[:n]


def test_the_lowest_ranks_are_found_with_few_pairs(tables, monkeypatch):
    sents, act = tables
    n, made = 20, []

    def counted(df):
        out = du.durable(df)
        made.append(out.count())
        return out

    monkeypatch.setattr(ip, "durable", counted)
    zeros = {f: len(zeros_of(f)) for f in range(5)}
    out = ip.first_zeros(sents, act, zeros, n, hash_rank(42, *SENTENCE_KEY))
    got = {}
    for r in out.collect():
        got.setdefault(r.feature_id, []).append(f"{r.accession_number}|{r.sentence_id}|{r.item_type}")
    for f in range(5):
        want = [key_of(i) for i in lowest(f, n)]
        rank = sorted(got.get(f, []), key=lambda k: hashlib.md5(f"42|{k}".encode()).hexdigest())
        assert rank[:n] == want
    assert len(got[4]) == 5 and 3 not in got
    # of 6,000 sentences and five features (10,035 zeros of features 0, 1, 2, 4) only a small multiple of n per feature is looked at
    assert sum(made) <= 5 * (n + ip.SURE * n ** 0.5 + ip.SURE) * 2


def test_a_range_that_was_too_small_is_widened(tables, monkeypatch):
    sents, act = tables
    monkeypatch.setattr(ip, "SURE", -2.0)  # far too few in the first round
    out = ip.first_zeros(sents, act, {0: len(zeros_of(0)), 1: N}, 20, hash_rank(42, *SENTENCE_KEY))
    for f in (0, 1):
        have = sorted((f"{r.accession_number}|{r.sentence_id}|{r.item_type}" for r in out.where(F.col("feature_id") == f).collect()),
                      key=lambda k: hashlib.md5(f"42|{k}".encode()).hexdigest())
        assert have[:20] == [key_of(i) for i in lowest(f, 20)]


def test_low_examples(tables):
    sents, act = tables
    rows = ip.low_examples(act, sents, [0, 1, 2], n=7).collect()
    for f in (0, 1, 2):
        own = sorted((r for r in rows if r.feature_id == f), key=lambda r: r.example)
        assert [r.text for r in own] == [f"text {i}" for i in lowest(f, 7)] and [r.example for r in own] == list(range(1, 8))
