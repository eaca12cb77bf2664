"""Surprisal with a word in a third of all rows, folds without firm id."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from filingpanel.functions import text as tx
from filingpanel.operators import sampling as sp, textscore as ts

SCHEMA = "accession_number string, sentence_id int, item_type string, cik long, year int, text string"


def sentences(n=1500):
    """One firm and year says one word in every second sentence."""
    rows = []
    for i in range(n):
        hot = i % 2 == 0
        text = "the" if hot else " ".join(f"w{(i * 7 + j) % 97}" for j in range(3)) + " The the"
        rows.append((f"a{i // 9}", i % 9, "item1", 1 if hot else i % 40, 2003 if hot else 2000 + i % 5, text))
    return rows + [("b", 0, "item1", None, 2001, "the"), ("b", 1, "item1", 1, None, "the"), ("b", 2, "item1", 1, 2004, ""), ("b", 3, "item1", 1, 2004, None)]


def brute(rows, agg):
    known = [(r[:3], r[3], r[4], (r[5] or "").lower().split()) for r in rows if r[3] is not None and r[4] is not None]
    counts, totals, vocab = Counter(), Counter(), set()
    for _, cik, year, words in known:
        vocab.update(words)
        totals[cik, year] += len(words)
        for w in words:
            counts[cik, w, year] += 1
    out = {}
    for key, cik, year, words in known:
        info = [-math.log((sum(counts[cik, w, t] for t in range(1999, year)) + 1) / (sum(totals[cik, t] for t in range(1999, year)) + len(vocab))) for w in words]
        if info:
            out[key] = (len(info), {"mean": sum(info) / len(info), "sum": sum(info), "max": max(info)}[agg])
    return out


@pytest.mark.parametrize("agg", ["mean", "sum", "max"])
def test_against_direct_counts(spark, agg, monkeypatch):
    rows = sentences()
    monkeypatch.setattr(ts.hot_keys, "__defaults__", (50,))
    got = ts.surprisal_novelty(spark.createDataFrame(rows, SCHEMA).repartition(5), agg).collect()
    want = brute(rows, agg)
    assert {tuple(r)[:3]: r.n_tokens for r in got} == {k: n for k, (n, _) in want.items()}
    assert all(r.novelty_surprisal == pytest.approx(want[tuple(r)[:3]][1]) for r in got)


def test_hot_keys_are_dealt_evenly(spark):
    """No part of a key holds more than one in ``share`` rows, and there are fewer hot keys than that."""
    tok = spark.createDataFrame([(1, "the", 2000)] * 4000 + [(i % 50, f"w{i % 300}", 2001) for i in range(6000)], "cik long, token string, year int")
    counts = tok.groupBy("cik", "token", "year").agg(F.count(F.lit(1)).alias("n_rows"))
    hot = {tuple(r)[:3]: r.salts for r in ts.hot_keys(counts, ["cik", "token", "year"], 100).collect()}
    assert hot == {(1, "the", 2000): 40}
    assert ts.hot_keys(counts.limit(0), ["cik", "token", "year"]).count() == 0
    salted = tok.withColumn("n", F.monotonically_increasing_id()).withColumn("s", F.pmod(F.xxhash64("n"), F.lit(40)))
    sizes = sorted(r["count"] for r in salted.where("token = 'the'").groupBy("s").count().collect())
    assert len(sizes) == 40 and sizes[-1] <= 4 * sizes[20]


def test_words_are_not_shuffled_one_by_one(spark):
    """Blocks of any size hold every sentence and count once; the text is counted once, and no stored row is that of a single word."""
    rows = sentences()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).where("cik IS NOT NULL AND year IS NOT NULL")
    counted = df.select(*ts.SENTENCE_KEY, "cik", "year", ts.word_counts(tx.lower_tokens(F.col("text"))).alias("words"))
    plan = ts.word_blocks(counted)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1
    for size in (1, 100, 1 << 18):
        blocks = ts.word_blocks(counted, block_words=size).collect()
        assert len({b.block for b in blocks}) == len(blocks) and (size > 100 or len(blocks) > 9)
        words, got = Counter(), {}
        for b in blocks:
            assert len({(d.cik, d.year, d.token) for d in b.dictionary}) == len(b.dictionary)
            words.update({(d.cik, d.year, d.token): d.c for d in b.dictionary})
            for s in b.sentences:
                assert all((b.dictionary[i].cik, b.dictionary[i].year) == (s.cik, s.year) for i in s.places)
                got[s.accession_number, s.sentence_id] = Counter({b.dictionary[i].token: n for i, n in zip(s.places, s.n)})
        known = [r for r in rows if r[3] is not None and r[4] is not None and (r[5] or "").split()]
        assert got == {r[:2]: Counter(r[5].lower().split()) for r in known}
        assert words == sum((Counter((r[3], r[4], w) for w in r[5].lower().split()) for r in known), Counter())


@pytest.mark.parametrize("agg", ["mean", "sum", "max"])
def test_repeated_and_incomplete_sentence_keys(spark, agg):
    rows = [("a", 0, "item1", 1, 2001, "x y"), ("a", 0, "item1", 1, 2001, "x y x z"), (None, None, None, 1, 2002, "x q"), ("b", 1, "item1", 2, 2002, " ")]
    got = {r.accession_number: r for r in ts.surprisal_novelty(spark.createDataFrame(rows, SCHEMA), agg).collect()}
    one, two = [-math.log(1 / 4)] * 6, [-math.log(4 / 10), -math.log(1 / 10)]
    value = {"mean": lambda v: sum(v) / len(v), "sum": sum, "max": max}[agg]
    assert set(got) == {"a", None} and (got["a"].n_tokens, got[None].n_tokens) == (6, 2)
    assert got["a"].novelty_surprisal == pytest.approx(value(one)) and got[None].novelty_surprisal == pytest.approx(value(two))


def test_word_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],), (["x"],), (["q"] * 500 + ["p"],)], "w array<string>")
    got = [{r.token: r.n for r in row[0]} for row in df.select(ts.word_counts(F.col("w"))).collect()]
    assert got == [{"a": 1, "b": 2}, {}, {"x": 1}, {"p": 1, "q": 500}]


def test_folds_without_firm(spark):
    rows = [(i, None if i % 3 == 0 else i % 7) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, cik long").repartition(4)
    got = {r.id: (r.cik, r.fold) for r in sp.panel_folds(df, 5, ["id"]).collect()}
    by_row = {r.id: r.fold for r in sp.kfold(df, 5, ["id"]).collect()}
    assert len(got) == 400 and all(f is not None for _, f in got.values())
    assert all(f == by_row[i] for i, (c, f) in got.items() if c is None)
    assert all(len({f for c, f in got.values() if c == firm}) == 1 for firm in range(7))
    assert {r.id: r.fold for r in sp.panel_folds(df.drop("cik"), 5, ["id"]).collect()} == by_row
    assert sp.panel_folds(df.limit(0), 5, ["id"]).count() == 0
