"""Registered queries: sentence scores (section D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.durable import durable
from ..operators import textscore as ts
from . import views as v
from .registry import query
from .views import DIGIT, with_views

_KEY = ["accession_number", "item_type", "sentence_id"]
_K = "accession_number, item_type, sentence_id"

_POS = """['profit','profitable','profits','success','successful','growth','growing','increase','increased','gain',
  'gains','improve','improved','improvement','strong','strength']"""
_NEG = """['loss','losses','decline','declined','decrease','decreased','risk','risks','uncertainty','uncertain',
  'litigation','adverse','adversely','negative','impairment','failure']"""

_READ = """
  select *, nw as word_count, round(case when nw > 0 then chars / (nw * 1e0) else 0e0 end, 6) as avg_word_length,
         round(206835e-3 - 1015e-3 * (nw / (ends * 1e0)) - 846e-1 * (syl / greatest(nw, 1)), 6) as flesch_score,
         round(4e-1 * (nw / (ends * 1e0) + 100e0 * cx / greatest(nw, 1)), 6) as fog_index,
         round(cx / (greatest(nw, 1) * 1e0), 6) as complex_word_ratio
  from (select *, cast(len(w) as int) as nw, list_sum(list_transform(w, lambda x: length(x))) as chars,
               list_sum(list_transform(w, lambda x: greatest(1e0, length(x) / 3e0))) as syl,
               len(list_filter(w, lambda x: length(x) > 6)) as cx,
               greatest(length(text) - length(replace(replace(replace(text, '.', ''), '!', ''), '?', '')), 1) as ends
        from word)"""
_SENT = f"""
  select *, pos as positive_word_count, neg as negative_word_count, pos - neg as sentiment_net,
         round((pos - neg) / (greatest(len(w), 1) * 1e0), 6) as sentiment_ratio
  from (select *, cast(len(list_intersect(list_distinct(lw), {_POS})) as int) as pos,
               cast(len(list_intersect(list_distinct(lw), {_NEG})) as int) as neg from {{0}})"""


def _round(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


_RCOLS = ["word_count", "avg_word_length", "flesch_score", "fog_index", "complex_word_ratio"]
_SCOLS = ["positive_word_count", "negative_word_count", "sentiment_net", "sentiment_ratio"]


@query("readability", with_views(f"select {_K}, {', '.join(_RCOLS)} from ({_READ})"))
def readability(spark, d):
    return _round(ts.readability(v.sentence(spark, d)).select(*_KEY, *_RCOLS), *_RCOLS[1:])


@query("sentiment", with_views(f"select {_K}, {', '.join(_SCOLS)} from ({_SENT.format('word')})"))
def sentiment(spark, d):
    return _round(ts.sentiment(v.sentence(spark, d)).select(*_KEY, *_SCOLS), "sentiment_ratio")


@query("baseline_features", with_views(f"""
  select {_K}, {', '.join(_RCOLS + _SCOLS)} from ({_SENT.format('(' + _READ + ')')})"""))
def baseline_features(spark, d):
    out = ts.baseline_features(v.sentence(spark, d)).select(*_KEY, *_RCOLS, *_SCOLS)
    return _round(out, *_RCOLS[1:], "sentiment_ratio")


@query("token_counts", with_views(rf"""
  select {_K}, cast(len(w) as int) as n_words,
         cast(len(list_filter(w, lambda x: regexp_matches(x, '{DIGIT}'))) as int) as n_numeric,
         cast(len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Lu}}') and length(x) > 1)) as int) as n_capitalised,
         cast(len(list_intersect(list_distinct(lw), ['risk', 'risks', 'the', 'la'])) as int) as n_keywords,
         round(len(list_distinct(w)) / (len(w) + 1e0), 6) as diversity from word"""))
def token_counts(spark, d):
    out = ts.token_counts(v.sentence(spark, d), ("risk", "risks", "the", "la"))
    return _round(out.select(*_KEY, "n_words", "n_numeric", "n_capitalised", "n_keywords", "diversity"), "diversity")


@query("firm_text_baselines", with_views("""
  select cik, round(avg(sentence_length), 6) as firm_length,
         round(avg(len(list_distinct(w)) / (len(w) + 1e0)), 6) as firm_diversity
  from word where cik is not null group by cik"""))
def firm_text_baselines(spark, d):
    return _round(ts.firm_text_baselines(v.sentence(spark, d)), "firm_length", "firm_diversity")


@query("novelty_proxy", with_views(f"select {_K}, round(novelty_cln, 6) as novelty_cln from scored"))
def novelty_proxy(spark, d):
    return _round(ts.novelty_proxy(v.sentence(spark, d)).select(*_KEY, "novelty_cln"), "novelty_cln")


@query("novelty_proxy_words", with_views(f"""
  select {_K}, round(4e-1 * abs(nw - fl) / (fl + 1) + 3e-1 * abs(div - fd)
         + 3e-1 * ((nums + caps) / (nw + 1e0)), 6) as novelty_cln
  from scored join (select cik, avg(nw) as fl, avg(div) as fd from scored group by cik) using (cik)"""))
def novelty_proxy_words(spark, d):
    out = ts.novelty_proxy(v.sentence(spark, d), length_unit="words")
    return _round(out.select(*_KEY, "novelty_cln"), "novelty_cln")


@query("relevance_proxy", with_views(f"select {_K}, round(relevance_kmnz, 6) as relevance_kmnz from measured"))
def relevance_proxy(spark, d):
    return _round(ts.relevance_proxy(v.sentence(spark, d)).select(*_KEY, "relevance_kmnz"), "relevance_kmnz")


_SURPRISAL = """
  tokens as (select accession_number, sentence_id, item_type, cik, year, unnest(lw) as token from word
             where cik is not null and year is not null),
  per_year as (select cik, token, year, count(*) as c from tokens group by all),
  firm_year as (select cik, year, sum(c) as c from per_year group by all),
  info as (
    select p.cik, p.token, p.year, -ln((coalesce(sum(p.c) over (partition by p.cik, p.token order by p.year
               rows between unbounded preceding and 1 preceding), 0) + 1e0)
             / (t.before + 1e0 * (select count(distinct token) from tokens))) as i
    from per_year p join (select cik, year, coalesce(sum(c) over (partition by cik order by year
               rows between unbounded preceding and 1 preceding), 0) as before from firm_year) t using (cik, year))
"""


def _surprisal_sql(value):
    return with_views(f"""with {_SURPRISAL}
  select accession_number, sentence_id, item_type, cik, year, count(*) as n_tokens,
         round({value}, 6) as novelty_surprisal
  from tokens join info using (cik, token, year) group by all""")


@query("surprisal_novelty", _surprisal_sql("avg(i)"))
def surprisal_novelty(spark, d):
    return _round(ts.surprisal_novelty(v.sentence(spark, d)), "novelty_surprisal")


@query("surprisal_novelty_max", _surprisal_sql("max(i)"))
def surprisal_novelty_max(spark, d):
    return _round(ts.surprisal_novelty(v.sentence(spark, d), "max"), "novelty_surprisal")


@query("surprisal_novelty_sum", _surprisal_sql("sum(i)"))
def surprisal_novelty_sum(spark, d):
    return _round(ts.surprisal_novelty(v.sentence(spark, d), "sum"), "novelty_surprisal")


@query("uniform_attention", with_views(f"""
  select {_K}, round(1e0 / count(*) over (partition by accession_number), 6) as relevance_kmnz from sentence"""))
def uniform_attention(spark, d):
    return _round(ts.attention_relevance(v.sentence(spark, d))[0].select(*_KEY, "relevance_kmnz"), "relevance_kmnz")


_ATTENTION = """
  att as (select *, exp(s - max(s) over (partition by accession_number)) as e
          from (select *, vec_id % 7 / 2e0 as s from sentence_embedding)),
  soft as (select *, e / sum(e) over (partition by accession_number) as a from att)"""


def _scored_embeddings(spark, d):
    e = v.sentence_embedding(spark, d).withColumn("s", F.col("vec_id") % 7 / 2.0)
    return ts.attention_relevance(e, "s", embedding="embedding")


@query("attention_relevance", with_views(f"""with {_ATTENTION}
  select {_K}, round(a, 6) as relevance_kmnz from soft"""))
def attention_relevance(spark, d):
    return _round(_scored_embeddings(spark, d)[0].select(*_KEY, "relevance_kmnz"), "relevance_kmnz")


@query("attention_pooling", with_views(f"""with {_ATTENTION}
  select accession_number, dim, round(sum(a * cast(x as double)), 6) as pooled from (
    select accession_number, a, unnest(embedding) as x, cast(generate_subscripts(embedding, 1) - 1 as int) as dim
    from soft where a is not null) group by all"""))
def attention_pooling(spark, d):
    out = _scored_embeddings(spark, d)[1].select("accession_number", F.posexplode("pooled").alias("dim", "pooled"))
    return _round(out, "pooled")


@query("attach_scores", with_views("""
  select e.vec_id, s.novelty_cln, 0e0 as relevance_kmnz
  from sentence_embedding e left join (
    select accession_number, sentence_id, item_type, min(novelty_cln) as novelty_cln
    from (select * from embedding_scores union all
          select accession_number, sentence_id, item_type, 9e0, 9e0 from embedding_scores)
    where novelty_cln > 4e-1 group by all) s using (accession_number, sentence_id, item_type)"""))
def attach_scores(spark, d):
    s = v.embedding_scores(spark, d)
    twice = s.unionByName(s.withColumn("novelty_cln", F.lit(9.0)).withColumn("relevance_kmnz", F.lit(9.0)))
    out = ts.attach_scores(v.sentence_embedding(spark, d), novelty=twice.where("novelty_cln > 0.4"))
    return out.select("vec_id", "novelty_cln", "relevance_kmnz")


def _describe_sql(col):
    return f"""select '{col}' as score, count({col}) as n, round(avg({col}), 6) as mean,
      round(stddev_samp({col}), 6) as std, round(min({col}), 6) as min, round(max({col}), 6) as max,
      round(quantile_cont({col}, 25e-2), 6) as q25, round(quantile_cont({col}, 5e-1), 6) as q50,
      round(quantile_cont({col}, 75e-2), 6) as q75 from scored"""


@query("describe_scores", with_views(
    _describe_sql("novelty_cln") + " union all " + _describe_sql("relevance_kmnz")))
def describe_scores(spark, d):
    s = durable(v.scored(spark, d).select("novelty_cln", "relevance_kmnz"))  # several passes read the scores
    out = ts.describe_score(s, "novelty_cln").unionByName(ts.describe_score(s, "relevance_kmnz"))
    return _round(out, "mean", "std", "min", "max", "q25", "q50", "q75")
