"""Texts stay in place when the other side of a join is small."""

from pyspark.sql import functions as F

from filingpanel.functions import sides
from filingpanel.operators import prepare as pp


def tables(spark):
    docs = spark.range(400).repartition(4).select(
        F.concat(F.lit("a"), F.col("id") % 150).alias("accession_number"), F.col("id").alias("cik"), F.lit("item1").alias("item_type"),
        F.repeat(F.lit("text "), 50).alias("text"), F.lit("T").alias("ticker"), F.lit("C").alias("company_name"), F.lit("x").alias("filing_date"))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    meta = spark.createDataFrame([(i % 150, f"a{i % 150}", f"T{i}", "Name", f"2020-01-{1 + i % 28:02d}") for i in range(300)],
                                 "cik long, accession_number string, ticker string, company_name string, filing_date string")
    return docs, meta


def text_moves(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return bool([line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]), plan


def test_text_is_in_no_exchange(spark):
    docs, meta = tables(spark)
    for out in (pp.consolidate_items([docs, docs], meta), pp.enrich_sentences(docs, meta)):
        moves, plan = text_moves(out)
        assert not moves and "BroadcastHashJoin" in plan
    both = pp.consolidate_items([docs, docs], meta)
    assert both.count() == 800 and both.where("filing_date IS NULL").count() == 0


def test_a_large_side_is_not_broadcast(spark, monkeypatch):
    docs, meta = tables(spark)
    small = sorted(map(str, pp.enrich_sentences(docs, meta).collect()))
    monkeypatch.setattr(sides.measured, "__defaults__", (10,))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = pp.enrich_sentences(docs, meta)
        moves, plan = text_moves(out)
        assert moves and "BroadcastHashJoin" not in plan
        assert sorted(map(str, out.collect())) == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
