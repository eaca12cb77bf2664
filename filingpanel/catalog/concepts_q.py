"""Registered queries: embeddings and concept encoder (section E)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..operators import concepts as cp, stability as sb
from ..sources.store import spread
from . import views as v
from .registry import query
from .views import with_views

_KEY = ["accession_number", "sentence_id", "item_type"]
_K = "accession_number, sentence_id, item_type"


def _round(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


def _elements(df, key, vector="embedding"):
    return _round(df.select(key, F.posexplode(vector).alias("dim", "value")), "value")


@query("hashed_embedding", f"""
  with w as (select doc_id, {v.tok("lower(coalesce(text, ''))")} as w from documents),
  g as (select doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as gram from w),
  c as (select doc_id, cast('0x' || substr(md5(gram), 1, 8) as bigint) % 64 as dim,
               sum(case when cast('0x' || substr(md5(gram), 9, 1) as bigint) % 2 = 1 then -1 else 1 end) as n from g group by 1, 2)
  select doc_id, cast(dim as int) as dim, round(cast(cast(n / sqrt(sum(n * n) over (partition by doc_id)) as float) as double), 5) as value from c where n <> 0""")
def hashed_embedding(spark, d):
    out = cp.embed(spread(v.table(spark, d, "documents").select("doc_id", "text"), v._parts(spark), "doc_id"), dim=64)
    return _round(out.select("doc_id", F.posexplode(vx.as_double(F.col("embedding"))).alias("dim", "value")).where("value <> 0"), "value", digits=5)


@query("l2_normalize", """
  with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double) * (1 + vec_id % 3)) as x
             from embeddings)
  select vec_id, cast(generate_subscripts(x, 1) - 1 as int) as dim,
         round(unnest(x) / sqrt(list_inner_product(x, x)), 6) as value from e""")
def l2_normalize(spark, d):
    e = v.table(spark, d, "embeddings").withColumn(
        "embedding", vx.scale(vx.as_double(F.col("embedding")), (F.lit(1) + F.col("vec_id") % 3).cast("double")))
    return _elements(cp.l2_normalize(e), "vec_id")


@query("rescale_to_sqrt_dim", """
  with e as (select vec_id, cast(embedding as double[]) as x from embeddings),
       f as (select sqrt(max(len(x))) / avg(sqrt(list_inner_product(x, x))) as f from e)
  select vec_id, cast(generate_subscripts(x, 1) - 1 as int) as dim, round(unnest(x) * f, 6) as value from e, f""")
def rescale_to_sqrt_dim(spark, d):
    return _elements(cp.rescale_to_sqrt_dim(v.table(spark, d, "embeddings")), "vec_id")


@query("ksparse_activations", with_views(f"select {_K}, feature_id, round(value, 6) as value from activation"))
def ksparse_activations(spark, d):
    return _round(v.activation(spark, d), "value")


@query("dense_activations", with_views(f"""
  select {_K}, feature_id, round(value, 6) as value from activation_all where value > 0"""))
def dense_activations(spark, d):
    out = cp.KSparseEncoderModel(v.encoder(), None).transform(v.sentence_embedding(spark, d))
    return _round(cp.to_long(out, _KEY), "value")


@query("activation_stats", with_views("""
  select round(count(*) * 1e0 / (select count(*) from sentence_embedding), 6) as mean_active,
         round(count(*) * 1e0 / (select count(*) from sentence_embedding) / 16, 6) as mean_frequency from activation"""))
def activation_stats(spark, d):
    out = cp.KSparseEncoderModel(v.encoder(), v.ENCODER_K).transform(v.sentence_embedding(spark, d))
    return _round(cp.activation_stats(out, v.ENCODER_M), "mean_active", "mean_frequency")


@query("activation_rates", with_views("""
  select j as feature_id, round(coalesce(c, 0) * 1e0 / n, 6) as rate, coalesce(c, 0) * 1e0 / n >= 25e-2 as alive
  from (select cast(j as int) as j from encoder)
  left join (select feature_id, count(*) as c from activation group by 1) on j = feature_id
  cross join (select count(*) as n from sentence_embedding)"""))
def activation_rates(spark, d):
    e = v.sentence_embedding(spark, d)
    features = spark.range(v.ENCODER_M).select(F.col("id").cast("int").alias("feature_id"))
    return _round(cp.activation_rates(v.activation(spark, d), e, features, 0.25), "rate")


@query("alive_features", with_views(f"""
  select {_K}, feature_id, round(value, 6) as value from activation where feature_id in (
    select feature_id from activation group by 1
    having count(*) >= 25e-2 * (select count(*) from sentence_embedding))"""))
def alive_features(spark, d):
    return _round(cp.alive_features(v.activation(spark, d), v.sentence_embedding(spark, d), 0.25), "value")


_WIDE = ", ".join(f"round(coalesce(max(value) filter (feature_id = {i}), 0), 6) as h_{i}" for i in range(16))


@query("activations_wide", with_views(f"select {_K}, {_WIDE} from activation group by {_K}"))
def activations_wide(spark, d):
    wide = cp.to_wide(v.activation(spark, d), _KEY, list(range(v.ENCODER_M)))
    return _round(wide, *[f"h_{i}" for i in range(v.ENCODER_M)])


@query("activations_wide_to_long", with_views(f"""
  select {_K}, cast(feature_id as varchar) as feature, round(value, 6) as value from activation"""))
def activations_wide_to_long(spark, d):
    wide = cp.to_wide(v.activation(spark, d), _KEY, list(range(v.ENCODER_M)))
    return _round(cp.wide_to_long(wide, _KEY), "value")


# Embeddings stand for decoder rows: replica = vec_id % 5, neuron = floor(vec_id / 5).
_MODELS_SQL = """
  models as (select vec_id % 5 as replica, cast(vec_id // 5 as int) as neuron, cast(embedding as double[]) as x
             from embeddings),
  unit as (select replica, neuron, list_transform(x, lambda t: t / (sqrt(list_inner_product(x, x)) + 1e-8)) as u
           from models),
  sim as (select a.replica as i, b.replica as j, a.neuron, max(list_inner_product(a.u, b.u)) as s
          from unit a join unit b on a.replica <> b.replica group by all),
  avg_sim as (select neuron, avg(s) as s from sim group by neuron)"""


def _models(spark, d):
    return v.table(spark, d, "embeddings").select(
        F.lit(64).alias("M"), F.lit(4).alias("k"), (F.col("vec_id") % 5).cast("int").alias("replica"),
        F.floor(F.col("vec_id") / 5).cast("int").alias("neuron"),
        vx.as_double(F.col("embedding")).alias("w_dec"))


@query("replica_similarity", with_views(f"""with {_MODELS_SQL}
  select 64 as "M", 4 as k, cast(i as int) as i, cast(j as int) as j, neuron, round(s, 6) as similarity from sim"""))
def replica_similarity(spark, d):
    return _round(sb.replica_similarity(_models(spark, d)), "similarity")


@query("stable_features", with_views(f"""with {_MODELS_SQL}
  select 64 as "M", 4 as k, neuron as neuron_idx, round(s, 6) as mean_similarity from avg_sim where s >= 30e-2"""))
def stable_features(spark, d):
    return _round(sb.stable_features(sb.replica_similarity(_models(spark, d)), 0.30), "mean_similarity")


@query("stable_features_anchor", with_views(f"""with {_MODELS_SQL}
  select 64 as "M", 4 as k, neuron as neuron_idx, round(avg(s), 6) as mean_similarity from sim where i = 0
  group by neuron having avg(s) >= 30e-2"""))
def stable_features_anchor(spark, d):
    return _round(sb.stable_features(sb.replica_similarity(_models(spark, d)), 0.30, anchor=0), "mean_similarity")


@query("stability_summary", with_views(f"""with {_MODELS_SQL}
  select 64 as "M", 4 as k, 5::bigint as n_replicas, count(*) as n_features_total,
         count(*) filter (s >= 30e-2) as n_stable, round(100e0 * count(*) filter (s >= 30e-2) / count(*), 6) as pct_stable,
         round(avg(s), 6) as similarity_mean, round(quantile_cont(s, 5e-1), 6) as similarity_median,
         round(stddev_pop(s), 6) as similarity_std, 30e-2 as threshold,
         case when count(*) filter (s >= 30e-2) < 200 then 'few: lower the threshold'
              when count(*) filter (s >= 30e-2) > 2000 then 'many: raise the threshold' else 'in range' end as advice
  from avg_sim"""))
def stability_summary(spark, d):
    m = _models(spark, d)
    out = sb.stability_summary(m, sb.replica_similarity(m), 0.30)
    return _round(out, "pct_stable", "similarity_mean", "similarity_median", "similarity_std")


@query("feature_metadata", with_views(f"""with {_MODELS_SQL}
  select 'h_M64_k4_n' || neuron as feature_name, 64 as "M", 4 as k, neuron as neuron_idx,
         round(s, 6) as mean_similarity, row_number() over (order by neuron) - 1 as global_feature_idx
  from avg_sim where s >= 30e-2"""))
def feature_metadata(spark, d):
    stable = sb.stable_features(sb.replica_similarity(_models(spark, d)), 0.30)
    return _round(cp.feature_metadata(stable), "mean_similarity")


def _closed_models(spark, sizes):
    """Closed-form weights as a models table: (M, k, replica, neuron, w_enc, b, w_dec)."""
    parts = []
    for m, k in sizes:
        w = F.transform(F.sequence(F.lit(1), F.lit(v.ENCODER_DIM)),
                        lambda i: F.sin((F.col("id") + 1).cast("double") * i.cast("double")))
        parts.append(spark.range(m).select(
            F.lit(m).alias("M"), F.lit(k).alias("k"), F.lit(0).alias("replica"), F.col("id").cast("int").alias("neuron"),
            w.alias("w_enc"), F.lit(0.0).alias("b"), w.alias("w_dec")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("stable_activations", with_views(f"""
  select {_K}, 'h_M16_k4_n' || feature_id as feature, round(value, 6) as value from activation where feature_id % 3 = 0
  union all
  select {_K}, 'h_M12_k3_n' || feature_id, round(value, 6) from (
    select *, row_number() over (partition by {_K} order by value desc) as r from activation_all where feature_id < 12)
  where r <= 3 and value > 0 and feature_id % 3 = 0"""))
def stable_activations(spark, d):
    models = _closed_models(spark, [(16, 4), (12, 3)])
    stable = models.where("neuron % 3 = 0").select("M", "k", F.col("neuron").alias("neuron_idx"))
    return _round(cp.stable_activations(v.sentence_embedding(spark, d), models, stable, _KEY), "value")


@query("loss_plateau", with_views("""
  with t as (select *, row_number() over (partition by run order by ts desc, event_id desc) as r from loss_log),
  s as (select run, count(*) as n, avg(loss) filter (r <= 10) as rec, avg(loss) filter (r between 11 and 20) as prev,
               max(loss) filter (r = 1) as l1, max(loss) filter (r = 10) as l10,
               stddev_pop(loss) filter (r <= 10) as sd from t group by run)
  select run, n as n_points,
         case when n >= 20 then round(case when prev > 0 then (prev - rec) / prev else 0 end, 6) end as improvement,
         n >= 20 and (case when prev > 0 then (prev - rec) / prev else 0 end) < 1e-3 as converged,
         case when n >= 10 then case when l1 < l10 then 'decreasing' else 'flat or increasing' end end as trend,
         case when n >= 10 then round(rec, 6) end as last10_mean, case when n >= 10 then round(sd, 6) end as last10_std
  from s"""))
def loss_plateau(spark, d):
    out = cp.loss_plateau(v.loss_log(spark, d), ["run"], ["ts", "event_id"])
    return _round(out, "improvement", "last10_mean", "last10_std")
