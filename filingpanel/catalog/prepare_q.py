"""Registered queries: filing preparation (section B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prepare
from . import views as v
from .registry import query
from .views import with_views

_META_SQL = """
  select case when accession_number <> 0 and length(cast(accession_number as varchar)) >= 8 then
           case when length(cast(cik as varchar)) < 10 then lpad(cast(cik as varchar), 10, '0')
                else cast(cik as varchar) end
           || '-' || substr(right(cast(accession_number as varchar), 8), 1, 2) || '-'
           || right(cast(accession_number as varchar), 6) end as accession_number,
         cik, fiscal_year, ticker, filing_date from metadata"""


@query("normalize_accession", with_views(f"""
  {_META_SQL} union all
  select case when p_partkey = 0 or length(cast(p_partkey * 100000 as varchar)) < 8 or p_size = 1 then null
         else lpad(cast(p_size as varchar), 10, '0') || '-'
              || substr(right(cast(p_partkey * 100000 as varchar), 8), 1, 2)
              || '-' || right(cast(p_partkey * 100000 as varchar), 6) end,
         case when p_size > 1 then p_size end, null, null, null from part"""))
def normalize_accession(spark, d):
    odd = v.table(spark, d, "part").select(
        (F.col("p_partkey") * 100000).alias("accession_number"),
        F.when(F.col("p_size") > 1, F.col("p_size").cast("long")).alias("cik"))
    both = v.metadata(spark, d).unionByName(odd, allowMissingColumns=True)
    return prepare.normalize_accession(both)


@query("cik_from_accession", """
  select doc_id, accession_number, case
      when cik is not null and cik <> 0 then cik
      when position('-' in accession_number) > 0 then try_cast(split_part(accession_number, '-', 1) as bigint)
    end as cik
  from (select doc_id, case doc_id % 5 when 0 then source when 1 then lpad(cast(n_chars as varchar), 10, '0')
                 else printf('%010d', n_chars) || '-' || lang end as accession_number,
               case doc_id % 3 when 0 then doc_id when 1 then 0 end as cik from documents)
  union all
  select turn, role || '-' || conv_id, case when turn > 0 then turn end from conversations""")
def cik_from_accession(spark, d):
    r = F.col("doc_id") % 5
    docs = v.table(spark, d, "documents").select(
        "doc_id",
        F.when(r == 0, F.col("source")).when(r == 1, F.lpad(F.col("n_chars").cast("string"), 10, "0"))
        .otherwise(F.concat(F.format_string("%010d", "n_chars"), F.lit("-"), F.col("lang")))
        .alias("accession_number"),
        F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).when(F.col("doc_id") % 3 == 1, F.lit(0)).alias("cik"))
    conv = v.table(spark, d, "conversations").select(
        F.col("turn").alias("doc_id"), F.concat("role", F.lit("-"), F.col("conv_id")).alias("accession_number"),
        F.when(F.col("turn") > 0, F.col("turn")).alias("cik"))
    return prepare.with_cik(docs.unionByName(conv))


def _items(spark, d):
    doc = v.document(spark, d).drop("doc_id")
    return [doc.where(F.col("item_type") == i) for i in ("item1", "item1A", "item7")]


_CONSOLIDATED = f"""
  select d.accession_number, d.cik, d.year, d.item_type, d.text_length, m.filing_date
  from document d left join (select accession_number, min(filing_date) as filing_date
                             from ({_META_SQL}) group by 1) m using (accession_number)"""


@query("consolidate_items", with_views(_CONSOLIDATED))
def consolidate_items(spark, d):
    return prepare.consolidate_items(_items(spark, d), prepare.normalize_accession(v.metadata(spark, d))).drop("text")


@query("date_coverage", with_views(f"""
  select count(*) as n_documents, count(filing_date) as n_dated, count(*) - count(filing_date) as n_missing
  from ({_CONSOLIDATED})"""))
def date_coverage(spark, d):
    return prepare.date_coverage(
        prepare.consolidate_items(_items(spark, d), prepare.normalize_accession(v.metadata(spark, d))))


def _tickers(spark, d):
    toxic = v.table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return v.document(spark, d).join(toxic, "doc_id", "left_semi").select(
        "cik", F.concat(F.lit("T"), F.col("cik")).alias("ticker"),
        F.concat(F.lit("Company "), F.col("cik")).alias("company_name"))


_ENRICHED = f"""
  select b.cik, b.accession_number, coalesce(t.ticker, 'UNKNOWN') as ticker,
         coalesce(t.company_name, 'Unknown Company') as company_name,
         try_cast(f.filing_date as date) as filing_date
  from (select distinct cik, accession_number from document) b
  left join (select distinct cik, 'T' || cik as ticker, 'Company ' || cik as company_name from document
             where doc_id in (select doc_id from labels where toxic = 1)) t using (cik)
  left join (select accession_number, min(case when length(filing_date) = 10 then filing_date end) as filing_date
             from ({_META_SQL}) group by 1) f using (accession_number)"""


def _enriched(spark, d):
    return prepare.enrich_documents(
        v.document(spark, d), _tickers(spark, d), prepare.normalize_accession(v.metadata(spark, d)))


@query("enrich_documents", with_views(_ENRICHED))
def enrich_documents(spark, d):
    return _enriched(spark, d)


@query("enrich_sentences", with_views(f"""
  select s.accession_number, s.cik, s.item_type, s.sentence_id, e.ticker, e.company_name, e.filing_date
  from sentence s left join ({_ENRICHED}) e using (cik, accession_number)"""))
def enrich_sentences(spark, d):
    return prepare.enrich_sentences(v.sentence(spark, d), _enriched(spark, d)).select(
        "accession_number", "cik", "item_type", "sentence_id", "ticker", "company_name", "filing_date")


@query("sentence_table", with_views("select * from sentence"))
def sentence_table(spark, d):
    return v.sentence(spark, d)


@query("sentences_per_document", with_views("""
  select cast(sum(c) as bigint) as n_sentences, count(*) as n_documents, round(avg(c), 6) as avg_sentences
  from (select count(*) as c from sentence group by accession_number, item_type)"""))
def sentences_per_document(spark, d):
    out = prepare.sentences_per_document(v.sentence(spark, d))
    return out.withColumn("avg_sentences", F.round("avg_sentences", 6))


@query("span_table", with_views("""
  select accession_number, cik, year, filing_date, item_type, paragraph_id, cast(sum(n) as bigint) as n_words,
         count(*) as n_sentences, string_agg(text, ' ' order by sentence_id) as text
  from (select *, cast(coalesce(sum(n) over (partition by accession_number, item_type order by sentence_id
                   rows between unbounded preceding and 1 preceding), 0) // 80 as int) as paragraph_id
        from (select *, len(w) as n from word))
  group by all"""))
def span_table(spark, d):
    return prepare.span_table(v.sentence(spark, d))
