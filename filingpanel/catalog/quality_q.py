"""Registered queries: data quality (section J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.durable import durable
from ..operators import quality as qa, textscore as ts
from . import views as v
from .registry import query
from .views import with_views



def _round(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


@query("quality_report", with_views("""
  with y as (select year, count(*) as n from document group by year)
  select count(*) as n_records, count(distinct accession_number) as n_filings, min(year) as first_year,
         max(year) as last_year, count(*) filter (text_length < 100) as n_short, count(cik) as n_cik,
         count(distinct cik) as n_firms, (select count(*) filter (n < 100) from y) as sparse_years,
         (select year from y order by n desc, year limit 1) as peak_year, (select max(n) from y) as peak_filings,
         round(count(*) filter (text_length < 100) * 1e2 / count(*), 6) as short_pct,
         round(count(cik) * 1e2 / count(*), 6) as cik_pct, count(cik) < 9e-1 * count(*) as cik_warning from document"""))
def quality_report(spark, d):
    return _round(qa.quality_report(v.document(spark, d)), "short_pct", "cik_pct")


@query("length_by_item", with_views("""
  select item_type, count(text_length) as n, round(avg(text_length), 6) as mean, min(text_length) as min,
         max(text_length) as max, round(quantile_cont(cast(text_length as double), 5e-1), 6) as median
  from document group by item_type"""))
def length_by_item(spark, d):
    return _round(qa.length_by_item(v.document(spark, d)), "mean", "median")


@query("schema_check", with_views("""
  select 'text' as phase, 'schema' as "check", false as passed, 'error' as severity, 'ticker' as detail
  union all
  select 'text', 'unique keys', count(*) = count(distinct accession_number || item_type), 'error',
         cast(count(*) - count(distinct accession_number || item_type) as varchar) from document"""))
def schema_check(spark, d):
    doc = v.document(spark, d)
    return qa.check_schema(doc, ["accession_number", "cik", "ticker", "text"], "text").unionByName(
        qa.check_from(qa.check_unique(doc, ["accession_number", "item_type"]), "text", "unique keys",
                      F.col("n_duplicates") == 0, F.col("n_duplicates")))


@query("null_counts", with_views(" union all ".join(
    f"""select '{c}' as "column", count(*) - count("{c}") as n_null from fundamental""" for c in ("at", "lt", "pstk"))))
def null_counts(spark, d):
    return qa.null_counts(v.fundamental(spark, d), ["at", "lt", "pstk"])


@query("coverage_check", with_views(" union all ".join(f"""
  select '{c}' as "column", count({c}) as n_present, count(*) as n_rows, round(count({c}) * 1e2 / count(*), 6) as pct,
         count({c}) * 1e2 / count(*) < 50 as low from fundamental""" for c in ("lt", "pstkrv", "pstk"))))
def coverage_check(spark, d):
    return _round(qa.check_coverage(v.fundamental(spark, d), ["lt", "pstkrv", "pstk"]), "pct")


@query("text_check", """
  select count(*) as n, count(*) filter (text is null or length(text) = 0) as n_empty,
         round(avg(length(text)), 6) as mean_length, round(quantile_cont(cast(length(text) as double), 5e-1), 6) as median_length
  from documents""")
def text_check(spark, d):
    return _round(qa.check_text(v.table(spark, d, "documents")), "mean_length", "median_length")


@query("item_distribution", with_views("select item_type, count(*) as n from sentence group by item_type"))
def item_distribution(spark, d):
    return qa.item_distribution(v.sentence(spark, d))


@query("unique_check", """
  select cast(sum(c - 1) as bigint) as n_duplicates, count(*) as n_keys
  from (select count(*) as c from lineitem group by l_orderkey, l_linenumber)""")
def unique_check(spark, d):
    return qa.check_unique(v.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("embedding_check", """
  select count(*) as n, cast(min(len(e)) as int) as min_dim, cast(max(len(e)) as int) as max_dim,
         count(*) filter (len(list_filter(e, lambda x: isnan(x))) > 0) as n_nan,
         count(*) filter (len(list_filter(e, lambda x: isinf(x))) > 0) as n_inf
  from (select case when vec_id % 50 = 1 then list_append(embedding, 'nan'::float)
                    when vec_id % 50 = 2 then list_append(embedding, '-inf'::float) else embedding end as e
        from embeddings)""")
def embedding_check(spark, d):
    e = v.table(spark, d, "embeddings")
    k = F.col("vec_id") % 50
    extra = F.when(k == 1, F.array(F.lit(float("nan")).cast("float"))).when(
        k == 2, F.array(F.lit(float("-inf")).cast("float"))).otherwise(F.array().cast("array<float>"))
    return qa.check_embeddings(e.withColumn("embedding", F.concat("embedding", extra)))


@query("range_check", with_views("""
  select count(novelty_cln) as n, count(*) filter (novelty_cln < 0) as n_below,
         count(*) filter (novelty_cln > 1) as n_above from scored"""))
def range_check(spark, d):
    return qa.check_range(v.scored(spark, d), "novelty_cln")


@query("count_match", with_views("""
  select (select count(*) from sentence) as n_first, (select count(*) from embeddings) as n_second,
         (select count(*) from sentence) = (select count(*) from embeddings) as match"""))
def count_match(spark, d):
    return qa.check_count_match(v.sentence(spark, d), v.table(spark, d, "embeddings"))


@query("key_coverage", """
  select count(distinct o_custkey) as n_first, (select count(distinct c_custkey) from customer) as n_second,
         round(count(distinct o_custkey) * 1e0 / (select count(distinct c_custkey) from customer), 6) as coverage
  from orders""")
def key_coverage(spark, d):
    a = v.table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return _round(qa.key_coverage(a, v.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k"), "coverage")


_PAIR = """
  a as (select o_orderkey as k, o_custkey as cik, o_orderstatus as item from orders where o_orderpriority <> '1-URGENT'),
  b as (select o_orderkey as k, case when o_orderkey % 9 = 0 then o_custkey + 1 else o_custkey end as cik,
               case when o_orderkey % 6 = 0 then 'X' else o_orderstatus end as item
        from orders where o_orderstatus <> 'P'),
  diff as (select k, case when not coalesce(in_a, false) then 'second only' when not coalesce(in_b, false) then 'first only'
                     else 'differs' end as state,
             case when in_a and in_b then
               case when a.cik <> b.cik and a.item <> b.item then 'cik,item' when a.cik <> b.cik then 'cik' else 'item' end
             else '' end as columns
           from (select *, true as in_a from a) a full join (select *, true as in_b from b) b using (k)
           where in_a is null or in_b is null or a.cik <> b.cik or a.item <> b.item)"""


def _pair(spark, d):
    o = v.table(spark, d, "orders")
    k = F.col("o_orderkey")
    a = o.where("o_orderpriority <> '1-URGENT'").select(
        k.alias("k"), F.col("o_custkey").alias("cik"), F.col("o_orderstatus").alias("item"))
    b = o.where("o_orderstatus <> 'P'").select(
        k.alias("k"), F.when(k % 9 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("cik"),
        F.when(k % 6 == 0, "X").otherwise(F.col("o_orderstatus")).alias("item"))
    return a, b, ["k"], ["cik", "item"]


@query("alignment_check", with_views(f"with {_PAIR} select state, columns, count(*) as n from diff group by all"))
def alignment_check(spark, d):
    return qa.check_alignment(*_pair(spark, d))


@query("alignment_first_differences", with_views(f"with {_PAIR} select k, state, columns from diff order by k limit 5"))
def alignment_first_differences(spark, d):
    return qa.first_differences(*_pair(spark, d))


@query("match_diagnosis", with_views("""
  with a as (select distinct accession_number as k from document),
       b as (select distinct case when doc_id % 2 = 0 then accession_number
                                  else replace(accession_number, '-', '') end as k from document
             where doc_id in (select doc_id from labels))
  select 'as is' as form, (select count(*) from a) as n_first, (select count(*) from b) as n_second,
         (select count(*) from a where k in (select k from b)) as n_matches
  union all
  select 'no hyphens', (select count(distinct replace(k, '-', '')) from a), (select count(distinct replace(k, '-', '')) from b),
         (select count(distinct replace(k, '-', '')) from a where replace(k, '-', '') in (select replace(k, '-', '') from b))"""))
def match_diagnosis(spark, d):
    doc = v.document(spark, d).select("doc_id", "accession_number")
    some = doc.join(v.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    b = some.select(F.when(F.col("doc_id") % 2 == 0, F.col("accession_number")).otherwise(
        F.replace("accession_number", F.lit("-"), F.lit(""))).alias("accession_number"))
    return qa.match_diagnosis(doc, b)


@query("guarded_left_join", """
  select o_orderkey, l_quantity, l_tax from orders left join (
    select l_orderkey as o_orderkey, unnest(arg_min({l_quantity: l_quantity, l_tax: l_tax},
                                             (l_linenumber, l_partkey, l_quantity, l_tax)))
    from lineitem where l_returnflag = 'A' group by 1) using (o_orderkey)""")
def guarded_left_join(spark, d):
    right = v.table(spark, d, "lineitem").where("l_returnflag = 'A'").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    out = qa.guarded_left_join(v.table(spark, d, "orders").select("o_orderkey"), right, ["o_orderkey"],
                               ["l_linenumber", "l_partkey"])
    return out.select("o_orderkey", "l_quantity", "l_tax")


@query("match_rate", """
  select count(*) as n, count(c) as n_matched, round(count(c) * 1e0 / count(*), 6) as rate
  from orders left join (select l_orderkey, count(*) as c from lineitem where l_returnflag = 'A' group by 1)
    on o_orderkey = l_orderkey""")
def match_rate(spark, d):
    return _round(qa.match_rate(guarded_left_join(spark, d), "l_quantity"), "rate")


@query("loss_log_check", """
  select count(*) as n_points, count(*) filter (event_type = 'error') as n_nan,
         count(*) > 0 and count(*) filter (event_type = 'error') = 0 as ok from events""")
def loss_log_check(spark, d):
    loss = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return qa.check_loss_log(v.table(spark, d, "events").select(loss.alias("loss")))


def _checks(spark, d):
    """One read per table; sentences are split once and stored."""
    sents = durable(v.sentence(spark, d))
    documents = qa.TableChecks(v.document(spark, d), "documents").has_columns(["accession_number", "cik", "text"]).unique(
        ["accession_number", "item_type"]).covered("cik")
    sentences = qa.TableChecks(sents, "sentences").none_where(
        "no empty text", F.col("text").isNull() | (F.length("text") == 0)).counted("item_type", "items")
    novelty = F.col("novelty_cln")
    scores = qa.TableChecks(ts.novelty_proxy(sents), "sentences").none_where(
        "novelty within 0 and 1", (novelty < 0) | (novelty > 1), "warning")
    embeddings = qa.TableChecks(v.table(spark, d, "embeddings"), "embeddings").as_many_as("one per sentence", sentences)
    return qa.checks_table(spark, [documents, sentences, scores, embeddings])


@query("validation_report", with_views("""
  with u as (select count(*) - count(distinct accession_number || item_type) as dup, count(cik) * 1e0 / count(*) as cov
             from document)
  select 'documents' as phase, 3::bigint as n_checks, cast(dup > 0 as bigint) as n_errors, cast(cov < 5e-1 as bigint) as n_warnings,
         0::bigint as n_info, case when dup > 0 then 'failed' else 'passed' end as status from u
  union all
  select 'sentences', 2 + (select count(distinct item_type) from sentence), 0,
         (select cast(count(*) filter (novelty_cln < 0 or novelty_cln > 1) > 0 as bigint) from scored),
         (select count(distinct item_type) from sentence), 'passed'
  union all
  select 'embeddings', 1, cast((select count(*) from sentence) <> (select count(*) from embeddings) as bigint), 0, 0,
         case when (select count(*) from sentence) <> (select count(*) from embeddings) then 'failed' else 'passed' end"""))
def validation_report(spark, d):
    return qa.validation_report(_checks(spark, d))


@query("run_summary", with_views("""
  select item_type, count(*) as n_documents, count(distinct accession_number) as n_filings, count(distinct cik) as n_firms,
         any_value(s) as n_sentences
  from document join (select item_type, count(*) as s from sentence group by 1) using (item_type) group by item_type"""))
def run_summary(spark, d):
    return qa.run_summary(v.document(spark, d), v.sentence(spark, d))
