"""Registered queries: sources (section A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.durable import durable_folder
from ..sources import archive, filings, market as mkt, metadata as md, store
from . import views as v
from .registry import query
from .views import with_views

_PATH = "'archive/' || item_type || '/' || year || '/' || accession_number || '.txt'"


def _paths(spark, d):
    parts = [F.lit("archive/"), F.col("item_type"), F.lit("/"), F.col("year").cast("string"), F.lit("/"),
             F.col("accession_number"), F.lit(".txt")]
    return v.document(spark, d).select(F.concat(*parts).alias("path"))


@query("path_keys", with_views(f"""
  select path, replace(split_part(path, '/', 4), '.txt', '') as accession_number,
         cast(split_part(path, '/', 3) as int) as year
  from (select {_PATH} as path from document)"""))
def path_keys(spark, d):
    return filings.with_path_keys(_paths(spark, d))


@query("recent_file_limit", with_views(f"""
  select path from (select {_PATH} as path, year from document) where year between 2020 and 2024
  order by path limit 50"""))
def recent_file_limit(spark, d):
    return filings.limit_files(_paths(spark, d), 50, [2020, 2021, 2022, 2023, 2024])


@query("file_limit_fallback", with_views(f"""
  select path from (select {_PATH} as path from document) order by path limit 50"""))
def file_limit_fallback(spark, d):
    return filings.limit_files(_paths(spark, d), 50, [1931, 1932])


@query("metadata_summary", with_views("""
  select min(fiscal_year) as first_year, max(fiscal_year) as last_year, count(*) as n_rows,
         count(distinct cik) as n_firms, count(distinct ticker) as n_tickers from metadata"""))
def metadata_summary(spark, d):
    return md.metadata_summary(v.metadata(spark, d))


@query("read_columns", "select event_id, user_id, value from events")
def read_columns(spark, d):
    return mkt.read_columns(spark, f"{d}/events.parquet", ["event_id", "user_id", "value"])


@query("embedding_index", with_views("""
  select chunk_idx, min(r) as start, max(r) + 1 as "end", count(*) as n,
         printf('embeddings_chunk_%04d', chunk_idx) as path
  from (select r, r // 128 as chunk_idx from (
     select row_number() over (order by accession_number, item_type, sentence_id) - 1 as r from sentence_embedding))
  group by chunk_idx"""))
def embedding_index(spark, d):
    return store.embedding_index(
        v.sentence_embedding(spark, d), ["accession_number", "item_type", "sentence_id"], 128)


@query("ticker_map", """
  select c_custkey as cik, 'T' || c_custkey as ticker, c_name as company_name from customer
  union all select c_custkey + 1000000, 'N' || c_nationkey, c_mktsegment from customer""")
def ticker_map(spark, d):
    c = v.table(spark, d, "customer")

    def entry(cik, ticker, title):
        return F.struct(cik.alias("cik_str"), ticker.alias("ticker"), title.alias("title"))

    one = entry(F.col("c_custkey"), F.concat(F.lit("T"), F.col("c_custkey")), F.col("c_name"))
    two = entry(F.col("c_custkey") + 1000000, F.concat(F.lit("N"), F.col("c_nationkey")), F.col("c_mktsegment"))
    return md.flatten_ticker_map(c.select(F.to_json(F.create_map(F.lit("0"), one, F.lit("1"), two)).alias("json")))


@query("recent_filings", """
  select o_custkey as cik, o_orderkey || '-1' as accession_number,
         strftime(o_orderdate, '%Y-%m-%d') as filing_date, '10-K' as form from orders
  union all
  select o_custkey, o_orderkey || '-2', strftime(o_orderdate + interval 30 day, '%Y-%m-%d'), o_orderstatus
  from orders""")
def recent_filings(spark, d):
    o = v.table(spark, d, "orders")
    day = F.to_date("o_orderdate")
    rec = F.struct(
        F.array(F.concat(F.col("o_orderkey"), F.lit("-1")), F.concat(F.col("o_orderkey"), F.lit("-2")))
        .alias("accessionNumber"),
        F.array(day.cast("string"), F.date_add(day, 30).cast("string")).alias("filingDate"),
        F.array(F.lit("10-K"), F.col("o_orderstatus")).alias("form"),
    )
    return md.flatten_recent_filings(o.select(F.col("o_custkey").alias("cik"), F.to_json(rec).alias("json")))


@query("extract_returns", with_views("""
  select date, permno, round(ret, 9) as ret, vol, prc, shrout, round(mkt_ret, 9) as mkt_ret
  from daily left join market using (date)
  where date between date '2024-01-05' and date '2024-01-25' and ret is not null
    and permno in (select permno from filing)"""))
def extract_returns(spark, d):
    out = mkt.extract_returns(v.daily(spark, d), v.filing(spark, d), "2024-01-05", "2024-01-25", v.market(spark, d))
    return out.withColumn("ret", F.round("ret", 9)).withColumn("mkt_ret", F.round("mkt_ret", 9))


@query("common_shares", """
  select c_custkey as permno, 9 + c_nationkey % 4 as shrcd from customer where 9 + c_nationkey % 4 in (10, 11)""")
def common_shares(spark, d):
    return mkt.filter_common_shares(v.table(spark, d, "customer").select(
        F.col("c_custkey").alias("permno"), (F.lit(9) + F.col("c_nationkey") % 4).alias("shrcd")))


@query("valid_links", """
  select permno, linktype, linkprim from (
    select o_custkey as permno, case o_orderstatus when 'F' then 'LU' when 'O' then 'LC' else 'NR' end as linktype,
           case when o_orderpriority like '1%' then 'P' when o_orderpriority like '2%' then 'C' else 'N' end as linkprim
    from orders) where linktype in ('LU', 'LC') and linkprim in ('P', 'C')""")
def valid_links(spark, d):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return mkt.filter_links(v.table(spark, d, "orders").select(
        F.col("o_custkey").alias("permno"),
        F.when(s == "F", "LU").when(s == "O", "LC").otherwise("NR").alias("linktype"),
        F.when(p.startswith("1"), "P").when(p.startswith("2"), "C").otherwise("N").alias("linkprim")))


@query("annual_eps", """
  select event_id, fpi, measure from (
    select event_id, cast(1 + user_id % 3 as varchar) as fpi,
           case when event_type in ('view', 'click') then 'EPS' else 'SAL' end as measure from events)
  where fpi = '1' and measure = 'EPS'""")
def annual_eps(spark, d):
    return mkt.filter_eps_annual(v.table(spark, d, "events").select(
        "event_id", (F.lit(1) + F.col("user_id") % 3).cast("string").alias("fpi"),
        F.when(F.col("event_type").isin("view", "click"), "EPS").otherwise("SAL").alias("measure")))


@query("standard_annual", """
  select record_id, indfmt, datafmt, popsrc, consol from (
    select o_orderkey as record_id, case when o_orderstatus = 'P' then 'FS' else 'INDL' end as indfmt,
           case when o_orderpriority like '5%' then 'SUMM_STD' else 'STD' end as datafmt,
           case when o_custkey % 5 = 0 then 'I' else 'D' end as popsrc,
           case when o_orderkey % 4 = 0 then 'P' else 'C' end as consol from orders)
  where indfmt = 'INDL' and datafmt = 'STD' and popsrc = 'D' and consol = 'C'""")
def standard_annual(spark, d):
    return mkt.filter_std_annual(v.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("record_id"),
        F.when(F.col("o_orderstatus") == "P", "FS").otherwise("INDL").alias("indfmt"),
        F.when(F.col("o_orderpriority").startswith("5"), "SUMM_STD").otherwise("STD").alias("datafmt"),
        F.when(F.col("o_custkey") % 5 == 0, "I").otherwise("D").alias("popsrc"),
        F.when(F.col("o_orderkey") % 4 == 0, "P").otherwise("C").alias("consol")))


@query("filing_archive", with_views("""
  select accession_number, try_cast(ltrim(split_part(accession_number, '-', 1), '0') as bigint) as cik, year, item_type,
         cast(length(t) as int) as text_length, md5(t) as text_md5
  from (select *, regexp_replace(text, '^[\\x09-\\x0D\\x1C-\\x20\\x{85}\\p{Z}]+|[\\x09-\\x0D\\x1C-\\x20\\x{85}\\p{Z}]+$', '', 'g') as t from document)
  where t <> ''"""))
def filing_archive(spark, d):
    """The filings written as zip archives per item, and read back by ranges of members."""
    folder, parts = durable_folder(spark), []
    docs = v.document(spark, d).withColumn("path", F.concat_ws("/", "item_type", "year", F.concat("accession_number", F.lit(".txt"))))
    for item in ("item1", "item1A", "item7"):
        archive.write_archives(docs.where(F.col("item_type") == item).select("path", F.col("text").alias("content")), f"{folder}/{item}")
        parts.append(filings.read_filing_archives(spark, f"{folder}/{item}", item))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(
        "accession_number", "cik", "year", "item_type", "text_length", F.md5("text").alias("text_md5"))
