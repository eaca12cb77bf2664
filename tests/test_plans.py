"""Plan shapes that matter at scale, and compositions against their parts."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from filingpanel.functions import sampling
from filingpanel.operators import quality as qa, textscore as ts
from filingpanel.operators.docpanel import document_scores
from filingpanel.plans.text_scores import filing_scores, score_sentences
from filingpanel.operators.prepare import sentence_table
from filingpanel.sources import market, store


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def docs(spark):
    words = ["Revenue rose by 12 percent in the year.", "Our debt fell while cash and sales grew.", "The Board met 4 times.",
             "Weather was fine and the plant ran well."]
    rows = [(f"{1 if i % 3 == 0 else 2 + i % 9:010d}-20-{i:06d}", 1 if i % 3 == 0 else 2 + i % 9, 2015 + i % 5,
             ["item1", "item1A", "item7"][i % 3 if i % 2 else 2], " ".join(words[(i + j) % 4] for j in range(2 + i % 7)))
            for i in range(90)]
    return spark.createDataFrame(rows, "accession_number string, cik long, year int, item_type string, text string").repartition(4)


def test_scores_in_one_pass_equal_the_separate_operators(docs):
    """Firm 1 holds a third of the documents."""
    sents = sentence_table(docs)
    key = ["accession_number", "item_type", "sentence_id"]
    apart = ts.novelty_proxy(ts.relevance_proxy(sents)).select(*key, "novelty_cln", "relevance_kmnz")
    for materialize in (True, False):
        once = score_sentences(sents, materialize).select(*key, "novelty_cln", "relevance_kmnz")
        a, b = (sorted(map(tuple, d.collect())) for d in (apart, once))
        assert len(a) == len(b) > 200
        assert all(x[:3] == y[:3] and x[3:] == pytest.approx(y[3:]) for x, y in zip(a, b))


def test_filing_scores_do_not_depend_on_partitions(docs):
    runs = [sorted(map(tuple, filing_scores(docs.repartition(p)).collect()), key=repr) for p in (1, 9)]
    assert [r[:4] for r in runs[0]] == [r[:4] for r in runs[1]]
    assert all(a[4:] == pytest.approx(b[4:]) for a, b in zip(*runs))
    assert len(runs[0]) == docs.count()


def test_first_known_value_of_a_document(spark):
    s = spark.createDataFrame([("a", "item1", 0, None, 5, 1.0, 0.5), ("a", "item1", 1, 2003, 6, None, 0.5), ("a", "item1", 2, 2004, 6, 3.0, None)],
                              "accession_number string, item_type string, sentence_id int, year int, cik long, novelty_cln double, relevance_kmnz double")
    r = document_scores(s).first()
    assert (r["year"], r["cik"], r["novelty_cln_mean"], r["novelty_cln_weighted"], r["n_sentences"]) == (2003, 5, 2.0, 1.0, 3)


def test_caps_are_limited_before_the_shuffle(spark):
    text = plan(sampling.cap_per_group(spark.range(100).withColumn("k", F.col("id") % 3), ["k"], 5, sampling.hash_rank(1, "id")))
    assert text.count("WindowGroupLimit") >= 4  # partial and final, for both levels


def test_columns_and_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.range(1000).select(F.col("id").alias("permno"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("date"),
                             F.rand(1).alias("ret"), F.lit("x").alias("other")).write.parquet(path)
    read = plan(market.read_columns(spark, path, ["permno", "ret"]))
    assert "ReadSchema: struct<permno:bigint,ret:double>" in read
    keys = spark.range(10).select(F.col("id").alias("permno"))
    cut = plan(market.extract_returns(spark.read.parquet(path).select("permno", "date", "ret"), keys, "2020-02-01", "2020-03-01"))
    assert "GreaterThanOrEqual(date" in cut and "IsNotNull(ret)" in cut and "other" not in cut


def test_spread_is_asked_for(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(0, 400, 1, 1).write.parquet(path)
    assert "Exchange" not in plan(store.spread(spark.read.parquet(path), None, "id"))
    assert "Exchange" in plan(store.spread(spark.read.parquet(path), 8, "id"))
