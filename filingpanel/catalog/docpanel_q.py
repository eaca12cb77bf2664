"""Registered queries: document aggregation (section F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import docpanel as dp
from . import views as v
from .registry import query
from .views import with_views

_K = "accession_number, sentence_id, item_type"


def _round(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


# Zeros are made explicitly here: every sentence times every feature.
_THR = """
  thr as (select f.feature_id, quantile_cont(coalesce(a.value, 0e0), 9e-1) as threshold
          from sentence_panel s cross join (select distinct feature_id from activation) f
          left join activation a using (accession_number, sentence_id, item_type, feature_id) group by 1)"""
_META = """
  meta as (select accession_number, item_type, arg_min(year, sentence_id) as year, arg_min(cik, sentence_id) as cik,
                  avg(novelty_cln) as novelty_cln_mean, max(novelty_cln) as novelty_cln_max,
                  coalesce(sum(novelty_cln * relevance_kmnz), 0) / greatest(coalesce(
                    sum(relevance_kmnz) filter (novelty_cln is not null), 0), 1e-8) as novelty_cln_weighted,
                  avg(relevance_kmnz) as relevance_kmnz_mean, count(*) as n_sentences
           from sentence_panel group by accession_number, item_type)"""
_FEAT = f"""{_THR}, {_META},
  feat as (select accession_number, item_type, feature_id, sum(value) / any_value(n_sentences) as mean_activation,
                  count(*) filter (value > threshold) * 1e0 / any_value(n_sentences) as freq_activation
           from activation join thr using (feature_id) join meta using (accession_number, item_type)
           group by accession_number, item_type, feature_id)"""
_MCOLS = ["novelty_cln_mean", "novelty_cln_max", "novelty_cln_weighted", "relevance_kmnz_mean"]
_MROUND = ", ".join(f"round({c}, 6) as {c}" for c in _MCOLS)


@query("feature_thresholds", with_views(f"with {_THR} select feature_id, round(threshold, 6) as threshold from thr"))
def feature_thresholds(spark, d):
    return _round(dp.feature_thresholds(v.activation(spark, d), v.sentence_panel(spark, d)), "threshold")


@query("feature_thresholds_median", with_views("""
  select feature_id, round(quantile_cont(coalesce(value, 0e0), 5e-1), 6) as threshold
  from sentence_panel s cross join (select distinct feature_id from activation) f
  left join activation a using (accession_number, sentence_id, item_type, feature_id) group by 1"""))
def feature_thresholds_median(spark, d):
    return _round(dp.feature_thresholds(v.activation(spark, d), v.sentence_panel(spark, d), 0.5), "threshold")


@query("document_meta", with_views(f"""with {_META}
  select accession_number, item_type, year, cik, {_MROUND}, n_sentences,
         row_number() over (order by accession_number, item_type) - 1 as doc_id from meta"""))
def document_meta(spark, d):
    return _round(dp.document_meta(v.sentence_panel(spark, d)), *_MCOLS)


@query("weighted_novelty", with_views(f"""with {_META}
  select accession_number, item_type, round(novelty_cln_weighted, 6) as novelty_cln_weighted from meta"""))
def weighted_novelty(spark, d):
    return _round(dp.weighted_novelty(v.sentence_panel(spark, d)), "novelty_cln_weighted")


@query("document_features", with_views(f"""with {_FEAT}
  select accession_number, item_type, feature_id, round(mean_activation, 6) as mean_activation,
         round(freq_activation, 6) as freq_activation from feat"""))
def document_features(spark, d):
    out = dp.document_features(v.sentence_panel(spark, d), v.activation(spark, d))
    return _round(out, "mean_activation", "freq_activation")


@query("document_panel", with_views(f"""with {_FEAT}
  select accession_number, item_type, year, cik, {_MROUND}, n_sentences, doc_id, feature_id,
         round(mean_activation, 6) as mean, round(freq_activation, 6) as freq
  from (select *, row_number() over (order by accession_number, item_type) - 1 as doc_id from meta)
  left join feat using (accession_number, item_type)"""))
def document_panel(spark, d):
    p = dp.document_panel(v.sentence_panel(spark, d), v.activation(spark, d))
    p = p.select(*[c for c in p.columns if c != "features"], F.inline_outer("features"))
    return _round(p, *_MCOLS, "mean", "freq")


@query("filing_representation", with_views("""
  select accession_number, cik, filing_date, dim, round(avg(cast(x as double)), 6) as z, count(*) as n_sentences from (
    select accession_number, cik, filing_date, unnest(embedding) as x,
           cast(generate_subscripts(embedding, 1) - 1 as int) as dim from sentence_embedding) group by all"""))
def filing_representation(spark, d):
    out = dp.filing_representation(v.sentence_embedding(spark, d))
    return _round(out.select("accession_number", "cik", "filing_date", F.posexplode("z").alias("dim", "z"),
                             "n_sentences"), "z")


@query("align_embeddings", with_views("""
  select vec_id, accession_number, sentence_id, item_type, len(embedding) as n, round(cast(embedding[1] as double), 6) as first
  from sentence_embedding join embedding_scores using (accession_number, sentence_id, item_type)
  where novelty_cln is not null and item_type = 'item7'"""))
def align_embeddings(spark, d):
    e = v.sentence_embedding(spark, d)
    s = v.embedding_scores(spark, d).where("novelty_cln is not null")
    out = dp.align_embeddings(s, e, "item7").join(e.select("vec_id", *_K.split(", ")), _K.split(", "))
    return out.select("vec_id", *_K.split(", "), F.size("embedding").cast("long").alias("n"),
                      F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("attach_outcomes", with_views("""
  select o_orderkey as accession_number, o_custkey, round(car, 6) as car_3d, round(drift, 6) as drift_30d
  from orders left join (
    select l_orderkey, arg_min(l_discount, (l_linenumber, l_partkey, l_discount, l_tax)) as car,
           arg_min(l_tax, (l_linenumber, l_partkey, l_discount, l_tax)) as drift
    from lineitem where l_returnflag = 'R' group by 1) on o_orderkey = l_orderkey"""))
def attach_outcomes(spark, d):
    outcomes = v.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("accession_number"), "l_linenumber", "l_partkey",
        F.col("l_discount").alias("car_minus1_plus1"), F.col("l_tax").alias("drift_30d"))
    panel = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("accession_number"), "o_custkey")
    out = dp.attach_outcomes(panel, outcomes, ["car_minus1_plus1", "drift_30d"], ["l_linenumber", "l_partkey"])
    return _round(out, "car_3d", "drift_30d")


@query("attach_controls", with_views("""
  select o_orderkey as accession_number, size, bm, leverage, past_ret, past_vol
  from orders left join (
    select l_orderkey, unnest(arg_min({size: l_quantity, bm: l_extendedprice, leverage: l_discount, past_ret: l_tax,
                                       past_vol: l_suppkey},
                  (l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_suppkey)))
    from lineitem where l_linestatus = 'O' group by 1) on o_orderkey = l_orderkey"""))
def attach_controls(spark, d):
    controls = v.table(spark, d, "lineitem").where("l_linestatus = 'O'").select(
        F.col("l_orderkey").alias("accession_number"), "l_linenumber", "l_partkey",
        F.col("l_quantity").alias("size"), F.col("l_extendedprice").alias("bm"), F.col("l_discount").alias("leverage"),
        F.col("l_tax").alias("past_ret"), F.col("l_suppkey").alias("past_vol"))
    panel = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("accession_number"))
    return dp.attach_controls(panel, controls, ["l_linenumber", "l_partkey"])


@query("merge_outcomes_controls", with_views("""
  select f.accession_number, f.permno, f.filing_date, d.vol, d.prc as size
  from filing f join daily d on f.permno = d.permno and f.filing_date = d.date"""))
def merge_outcomes_controls(spark, d):
    daily, f = v.daily(spark, d), v.filing(spark, d).drop("ticker")
    keyed = f.join(daily, (f.permno == daily.permno) & (f.filing_date == daily.date))
    controls = keyed.select("accession_number", f.permno, F.lit(None).cast("date").alias("filing_date"), "vol",
                            F.col("prc").alias("size"))
    return dp.merge_outcomes_controls(f, controls)


@query("concept_profile", with_views("""
  with p as (select feature_id, avg(novelty_cln) as novelty, avg(relevance_kmnz) as relevance, count(*) as n_active,
                    avg(case when item_type = 'item1' then 1e0 else 0e0 end) as share_item1,
                    avg(case when item_type = 'item1A' then 1e0 else 0e0 end) as share_item1A,
                    avg(case when item_type = 'item7' then 1e0 else 0e0 end) as share_item7
             from activation join sentence_panel using (accession_number, sentence_id, item_type) group by 1),
       m as (select median(novelty) as mn, median(relevance) as mr from p)
  select feature_id, round(novelty, 6) as novelty, round(relevance, 6) as relevance, n_active,
         round(share_item1, 6) as share_item1, round(share_item1A, 6) as share_item1A,
         round(share_item7, 6) as share_item7,
         case when novelty >= mn and relevance >= mr then 'novel relevant' when novelty >= mn then 'novel irrelevant'
              when relevance >= mr then 'familiar relevant' else 'familiar irrelevant' end as quadrant from p, m"""))
def concept_profile(spark, d):
    out = dp.concept_profile(v.activation(spark, d), v.sentence_panel(spark, d))
    return _round(out, "novelty", "relevance", "share_item1", "share_item1A", "share_item7")
