"""Registered queries: concept interpretation (section I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.durable import durable
from ..operators import interpret as ip
from . import views as v
from .registry import query
from .views import with_views

_FEATURES = list(range(16))  # all of the model
_KEY = ["accession_number", "sentence_id", "item_type"]
_K = "accession_number, sentence_id, item_type"
_RANK = "md5('42|' || accession_number || '|' || sentence_id || '|' || item_type)"


def _round(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


def _sents(spark, d):
    """Embedded sentences with a text made from their key."""
    text = F.concat(F.lit("Sentence "), F.col("sentence_id"), F.lit(" of filing "), F.col("accession_number"),
                    F.lit(" in "), F.col("item_type"), F.repeat(F.lit(" and more"), 30))
    return v.sentence_embedding(spark, d).drop("embedding").withColumn("text", text)


_EXAMPLES = f"""
  txt as (select *, 'Sentence ' || sentence_id || ' of filing ' || accession_number || ' in ' || item_type
                    || repeat(' and more', 30) as text from sentence_embedding),
  full_act as (select {_K}, f.feature_id, coalesce(a.value, 0e0) as value, text
               from txt cross join (select unnest(range(16)) as feature_id) f
               left join activation a using ({_K}, feature_id)),
  cuts as (select feature_id, quantile_cont(value, 95e-2) as hi from full_act group by 1),
  high as (select * from (select f.*, row_number() over (partition by feature_id order by {_RANK}) as example
           from full_act f join cuts using (feature_id) where value > hi) where example <= 20),
  low as (select * from (select *, row_number() over (partition by feature_id order by {_RANK}) as example
          from full_act where value = 0) where example <= 20)"""
_EX_OUT = f"select {_K}, feature_id, round(value, 6) as value, cast(example as int) as example, text from "


@query("high_examples", with_views(f"with {_EXAMPLES} {_EX_OUT} high"))
def high_examples(spark, d):
    out = ip.high_examples(durable(v.activation(spark, d)), _sents(spark, d), _FEATURES)
    return _round(out.select(*_KEY, "feature_id", "value", "example", "text"), "value")


@query("low_examples", with_views(f"with {_EXAMPLES} {_EX_OUT} low"))
def low_examples(spark, d):
    out = ip.low_examples(durable(v.activation(spark, d)), _sents(spark, d), _FEATURES)
    return _round(out.select(*_KEY, "feature_id", "value", "example", "text"), "value")


@query("interpretation_prompts", with_views(f"""with {_EXAMPLES},
  h as (select feature_id, string_agg(example || '. ' || substr(text, 1, 200) || '...', chr(10) order by example) as high
        from high where example <= 10 group by 1),
  l as (select feature_id, string_agg(example || '. ' || substr(text, 1, 200) || '...', chr(10) order by example) as low
        from low where example <= 10 group by 1)
  select feature_id, high, low, 'Sentences that activate feature ' || feature_id || ':' || chr(10) || high
         || chr(10) || chr(10) || 'Sentences that do not:' || chr(10) || low || chr(10) || chr(10)
         || 'Name the pattern shared by the first group and absent from the second in one or two sentences.' as prompt
  from h join l using (feature_id)"""))
def interpretation_prompts(spark, d):
    a, s = durable(v.activation(spark, d)), _sents(spark, d)
    return ip.interpretation_prompts(ip.high_examples(a, s, _FEATURES), ip.low_examples(a, s, _FEATURES))


@query("evaluation_sample", with_views(f"""
  select {_K} from sentence_embedding
  order by {_RANK} limit 100"""))
def evaluation_sample(spark, d):
    return ip.evaluation_sample(v.sentence_embedding(spark, d)).select(*_KEY)


_FID = """
  fid as (
    select f as feature_id, n as n_eval, p as precision, r as recall,
           case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1
    from (select f, n, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p,
                 case when tp + fn > 0 then tp / (tp + fn) else 0 end as r
          from (select doc_id % 4 as f, count(*) as n, count(*) filter (quality = 1 and toxic = 0) * 1e0 as tp,
                       count(*) filter (quality = 0 and toxic = 0) * 1e0 as fp,
                       count(*) filter (quality = 1 and toxic = 1) * 1e0 as fn from labels group by 1)))"""


def _fidelity(spark, d):
    return ip.fidelity(v.table(spark, d, "labels").select(
        (F.col("doc_id") % 4).alias("feature_id"), (F.col("quality") == 1).alias("truth"),
        (F.col("toxic") == 0).alias("pred")))


@query("fidelity", with_views(f"""with {_FID}
  select feature_id, n_eval, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from fid"""))
def fidelity(spark, d):
    return _round(_fidelity(spark, d), "precision", "recall", "f1")


@query("high_fidelity", with_views(f"""with {_FID}
  select doc_id, feature_id from (select doc_id, doc_id % 4 as feature_id from documents)
  where feature_id in (select feature_id from fid where f1 > (select avg(f1) from fid))"""))
def high_fidelity(spark, d):
    f = _fidelity(spark, d)
    # the mean F1 stands for the threshold, so that some concepts pass and some fail
    cut = f.agg(F.avg("f1").alias("m")).scalar()
    docs = v.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 4).alias("feature_id"))
    return ip.high_fidelity(docs, f, cut)


_NAMES = """
  lasso as (select outcome, case feature % 3 when 0 then 'mean_M16_k4_n' || feature // 3
                   when 1 then 'freq_M16_k4_n' || feature // 3 else 'novelty_' || feature // 3 end as feature, coefficient
            from test_result)"""


def _lasso(spark, d):
    k, n = F.col("feature") % 3, F.floor(F.col("feature") / 3).cast("string")
    name = F.when(k == 0, F.concat(F.lit("mean_M16_k4_n"), n)).when(k == 1, F.concat(F.lit("freq_M16_k4_n"), n)).otherwise(
        F.concat(F.lit("novelty_"), n))
    return v.test_result(spark, d).select("outcome", name.alias("feature"), "coefficient")


@query("activation_columns", with_views(f"""with {_NAMES}
  select distinct replace(replace(feature, 'mean_M', 'h_M'), 'freq_M', 'h_M') as activation from lasso"""))
def activation_columns(spark, d):
    return ip.activation_columns(_lasso(spark, d))


@query("outcomes_to_interpret", with_views(f"""with {_NAMES}
  select outcome, count(*) as n_features_selected from lasso where abs(coefficient) > 2e-1 group by outcome"""))
def outcomes_to_interpret(spark, d):
    return ip.outcomes_to_interpret(_lasso(spark, d).where("abs(coefficient) > 0.2"))


@query("top_features", with_views(f"""with {_NAMES}
  select * from (select *, cast(row_number() over (partition by outcome order by abs(coefficient) desc, feature) as int)
                 as rank from lasso) where rank <= 5"""))
def top_features(spark, d):
    return ip.top_features(_lasso(spark, d), 5)


@query("interpretation_summary", with_views(f"""with {_NAMES}
  select outcome, count(*) as n_features_selected, count(*) filter (coefficient > 0) as n_interpreted,
         count(*) filter (coefficient > 2e-1) as n_high_fidelity from lasso group by outcome"""))
def interpretation_summary(spark, d):
    a = _lasso(spark, d)
    return ip.interpretation_summary(a, a.where("coefficient > 0"), a.where("coefficient > 0.2"))
