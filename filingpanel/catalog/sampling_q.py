"""Registered queries: samplers and splits (section C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as sp
from . import views as v
from .registry import query
from .views import with_views

_KEYS = "accession_number, item_type, sentence_id"
_RANK = "md5('42|' || accession_number || '|' || item_type || '|' || sentence_id)"


def _cols(df):
    return df.select("accession_number", "cik", "year", "item_type", "sentence_id")


def _cap(src, keys, cap, null_cap=None):
    first = keys.split(",")[0]
    limit = f"case when {first} is null then {null_cap} else {cap} end" if null_cap else str(cap)
    return f"""(select * exclude (rn) from (
      select *, row_number() over (partition by {keys} order by {_RANK}) as rn from {src}) where rn <= {limit})"""


_OUT = "select accession_number, cik, year, item_type, sentence_id from "


@query("cap_per_stratum", with_views(_OUT + _cap("sentence", "cik, item_type", 50, 7)))
def cap_per_stratum(spark, d):
    return _cols(sp.cap_per_stratum(_cols(v.sentence(spark, d)), ["cik", "item_type"], 50, null_cap=7))


_FIRST = _cap("sentence", "cik, year, item_type", 30)
_SECOND = _cap(_FIRST, "cik", 200, 40)
_THIRD = _cap(_SECOND, "year, item_type", 60)


@query("stratified_sample", with_views(_OUT + _THIRD))
def stratified_sample(spark, d):
    return _cols(sp.stratified_sample(_cols(v.sentence(spark, d)), 30, 200, 60, null_firm=40))


@query("stratified_sample_defaults", with_views(
    _OUT + _cap(_cap(_cap("sentence", "cik, year, item_type", 300), "cik", 5000, 100), "year, item_type", 20000)))
def stratified_sample_defaults(spark, d):
    return _cols(sp.stratified_sample(_cols(v.sentence(spark, d))))


@query("firm_balanced_sample", with_views(
    _OUT + _cap(_cap("sentence", "cik", 200, 40), "year, item_type", 100) + f" order by {_RANK} limit 2000"))
def firm_balanced_sample(spark, d):
    return _cols(sp.firm_balanced_sample(_cols(v.sentence(spark, d)), 200, 100, 2000, null_firm=40))


@query("sample_n", with_views(f"{_OUT} sentence order by {_RANK} limit 5000"))
def sample_n(spark, d):
    return sp.sample_n(_cols(v.sentence(spark, d)), 5000)


@query("bootstrap_filings", with_views(f"""
  {_OUT} sentence where accession_number in (
    select accession_number from (
      select accession_number, row_number() over (order by md5('45|' || accession_number)) as r, count(*) over () as n
      from (select distinct accession_number from sentence)) where r <= floor(8e-1 * n))"""))
def bootstrap_filings(spark, d):
    return sp.bootstrap_filings(_cols(v.sentence(spark, d)), 0.8, 3)


@query("firm_folds", with_views("""
  select accession_number, item_type, cik, fold from document left join (
    select cik, cast((row_number() over (order by md5('42|' || cik)) - 1) % 5 as int) as fold
    from (select distinct cik from document where cik is not null)) using (cik)"""))
def firm_folds(spark, d):
    return sp.firm_folds(v.document(spark, d).select("accession_number", "item_type", "cik"))


@query("panel_folds", with_views("""
  select accession_number, item_type, cik,
         coalesce(fold, cast(cast('0x' || substr(md5('42|' || accession_number || '|' || item_type), 1, 8) as bigint) % 5 as int)) as fold
  from document left join (
    select cik, cast((row_number() over (order by md5('42|' || cik)) - 1) % 5 as int) as fold
    from (select distinct cik from document where cik is not null)) using (cik)"""))
def panel_folds(spark, d):
    return sp.panel_folds(v.document(spark, d).select("accession_number", "item_type", "cik"), 5, ["accession_number", "item_type"])


@query("row_folds", """
  select l_orderkey, l_linenumber,
         cast(cast('0x' || substr(md5('42|' || l_orderkey || '|' || l_linenumber), 1, 8) as bigint) % 5 as int) as fold
  from lineitem""")
def row_folds(spark, d):
    return sp.kfold(v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), 5,
                    ["l_orderkey", "l_linenumber"])


@query("temporal_split", with_views("""
  select split, count(*) as n, min(year) as first_year, max(year) as last_year from (
    select year, case when year < 1999 then 'train' else 'test' end as split from panel) group by split"""))
def temporal_split(spark, d):
    return sp.temporal_split(v.panel(spark, d), 1999).groupBy("split").agg(
        F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("temporal_split_fallback", with_views("""
  select 'train' as split, count(*) as n from panel"""))
def temporal_split_fallback(spark, d):
    return sp.temporal_split(v.panel(spark, d), 1901).groupBy("split").agg(F.count("*").alias("n"))


_CAPPED = _cap("sentence", "cik", 1100, 40)


@query("firm_count_summary", with_views(f"""
  select count(*) as n_firms, cast(sum(n) as bigint) as n_rows, round(avg(n), 6) as mean, min(n) as min,
         max(n) as max, round(stddev_samp(n), 6) as std, count(*) filter (n = 1100) as at_cap,
         count(*) filter (n < 100) as below_100, count(*) filter (n >= 100 and n < 1000) as from_100,
         count(*) filter (n >= 1000 and n < 1100) as from_1000,
         round(quantile_cont(cast(n as double), 5e-1), 6) as median
  from (select cik, count(*) as n from {_CAPPED} where cik is not null group by cik)"""))
def firm_count_summary(spark, d):
    s = sp.cap_per_stratum(_cols(v.sentence(spark, d)), ["cik"], 1100, null_cap=40)
    out = sp.firm_count_summary(s, 1100)
    return out.select(*[F.round(c, 6).alias(c) if c in ("mean", "std", "median") else c for c in out.columns])


@query("sampling_rate", with_views(f"""
  select (select count(*) from {_CAPPED}) as n_sample, count(*) as n_full,
         round((select count(*) from {_CAPPED}) * 1e2 / count(*), 6) as rate_pct from sentence"""))
def sampling_rate(spark, d):
    s = _cols(v.sentence(spark, d))
    out = sp.sampling_rate(sp.cap_per_stratum(s, ["cik"], 1100, null_cap=40), s)
    return out.withColumn("rate_pct", F.round("rate_pct", 6))


@query("year_item_counts", with_views("""
  select year, count(*) filter (item_type = 'item1') as item1, count(*) filter (item_type = 'item1A') as item1A,
         count(*) filter (item_type = 'item7') as item7 from sentence group by year"""))
def year_item_counts(spark, d):
    return sp.year_item_counts(v.sentence(spark, d), ["item1", "item1A", "item7"])


@query("reduction_report", with_views(f"""
  select count(*) as n_groups, count(*) filter (n > 30) as n_capped, cast(sum(n) as bigint) as n_before,
         cast(sum(least(n, 30)) as bigint) as n_after,
         round((1 - sum(least(n, 30)) / (sum(n) * 1e0)) * 1e2, 6) as removed_pct
  from (select count(*) as n from sentence group by cik, year, item_type)"""))
def reduction_report(spark, d):
    s, keys = _cols(v.sentence(spark, d)), ["cik", "year", "item_type"]
    out = sp.reduction_report(s, sp.cap_per_stratum(s, keys, 30), keys, 30)
    return out.withColumn("removed_pct", F.round("removed_pct", 6))


@query("top_firms", with_views("""
  select cik, count(*) as n_rows from sentence where cik is not null group by cik order by 2 desc, 1 limit 10"""))
def top_firms(spark, d):
    return sp.top_groups(v.sentence(spark, d), "cik", 10)


@query("bottom_firms", with_views("""
  select cik, count(*) as n_rows from sentence where cik is not null group by cik order by 2, 1 limit 10"""))
def bottom_firms(spark, d):
    return sp.top_groups(v.sentence(spark, d), "cik", 10, smallest=True)
