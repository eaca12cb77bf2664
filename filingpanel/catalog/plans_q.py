"""Registered queries: whole compositions, training and streaming."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions.durable import shared_folder
from ..operators import concepts as cp, stability as sb, training as tr
from ..plans import concept_panel as pc, event_panel as pe, text_scores as pt
from ..streaming.loss_monitor import latest_status, loss_plateau_stream
from . import tail_sql, views as v
from .registry import oracle_sql, query
from .views import with_views

_KEY = ["accession_number", "sentence_id", "item_type"]


def _round(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


@query("filing_scores", with_views("""
  select accession_number, item_type, year, any_value(cik) as cik, round(avg(novelty_cln), 6) as novelty_cln_mean,
         round(max(novelty_cln), 6) as novelty_cln_max,
         round(sum(novelty_cln * relevance_kmnz) / greatest(sum(relevance_kmnz), 1e-8), 6) as novelty_cln_weighted,
         round(avg(relevance_kmnz), 6) as relevance_kmnz_mean, count(*) as n_sentences
  from scored group by accession_number, item_type, year"""))
def filing_scores(spark, d):
    out = pt.filing_scores(v.document(spark, d))
    return _round(out, "novelty_cln_mean", "novelty_cln_max", "novelty_cln_weighted", "relevance_kmnz_mean")


_COLS = ", ".join(
    f"round(coalesce(sum(value) filter (feature_id = {f}) * 1e0 / any_value(n), 0), 6) as mean_{f}" for f in range(16)
) + ", " + ", ".join(
    f"round(count(*) filter (feature_id = {f} and value > threshold) * 1e0 / any_value(n), 6) as freq_{f}" for f in range(16))


@query("concept_panel", with_views(f"""
  with thr as (select f.feature_id, quantile_cont(coalesce(a.value, 0e0), 9e-1) as threshold
               from sentence_panel s cross join (select distinct feature_id from activation) f
               left join activation a using (accession_number, sentence_id, item_type, feature_id) group by 1),
       docs as (select accession_number, item_type, count(*) as n, arg_min(year, sentence_id) as year,
                       round(avg(novelty_cln), 6) as novelty_cln_mean from sentence_panel group by 1, 2)
  select accession_number, item_type, any_value(n) as n_sentences, any_value(year) as year,
         any_value(novelty_cln_mean) as novelty_cln_mean, {_COLS}
  from docs left join (select * from activation join thr using (feature_id)) using (accession_number, item_type)
  group by accession_number, item_type"""))
def concept_panel(spark, d):
    e = v.sentence_embedding(spark, d).select(*_KEY, "embedding")
    sents = v.sentence_panel(spark, d).join(e, _KEY)
    p = pc.concept_panel(sents, cp.KSparseEncoderModel(v.encoder(), v.ENCODER_K), list(range(16)))
    cols = [f"{k}_{f}" for k in ("mean", "freq") for f in range(16)]
    return _round(p.select("accession_number", "item_type", "n_sentences", "year", "novelty_cln_mean", *cols),
                  "novelty_cln_mean", *cols)


@query("concept_selection")
def concept_selection(spark, d):
    """Lasso of the document novelty on the concept columns."""
    e = v.sentence_embedding(spark, d).select(*_KEY, "embedding")
    sents = v.sentence_panel(spark, d).join(e, _KEY)
    p = pc.concept_panel(sents, cp.KSparseEncoderModel(v.encoder(), v.ENCODER_K), list(range(v.ENCODER_M)))
    return pc.select_concepts(p, ["novelty_cln_mean"], key=["accession_number", "item_type"], min_rows=20)


def _three_sql():
    """OLS on three regressors by the adjugate of their cross products, robust errors, and both tests corrected."""
    def minor(i, j):
        r, c = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
        s = lambda p, q: f"s{min(p, q)}{max(p, q)}"
        return f"({'-' if (i + j) % 2 else ''}({s(r[0], c[0])} * {s(r[1], c[1])} - {s(r[0], c[1])} * {s(r[1], c[0])}) / det)"

    d = "d0 d1 d2".split()
    sums = ", ".join(f"sum(d{i} * d{j}) as s{i}{j}" for i in range(3) for j in range(i, 3)) + ", " + ", ".join(f"sum({x} * dy) as t{i}" for i, x in enumerate(d))
    det = "s00 * (s11 * s22 - s12 * s12) - s01 * (s01 * s22 - s12 * s02) + s02 * (s01 * s12 - s11 * s02)"
    inverse = ", ".join(f"{minor(i, j)} as i{i}{j}" for i in range(3) for j in range(3))
    slopes = ", ".join(f"i{i}0 * t0 + i{i}1 * t1 + i{i}2 * t2 as b{i}" for i in range(3))
    rows = ", ".join(f"i{i}0 * d0 + i{i}1 * d1 + i{i}2 * d2 as g{i}" for i in range(3))
    variances = ", ".join(f"sqrt(sum(e * e * g{i} * g{i}) * any_value(n) / (any_value(n) - 4)) as se{i}, any_value(b{i}) as b{i}" for i in (1, 2))
    return with_views(f"""
  with c as (select x1 - m0 as d0, x2 - m1 as d1, x3 - m2 as d2, y - my as dy, n from panel,
               (select avg(x1) as m0, avg(x2) as m1, avg(x3) as m2, avg(y) as my, count(*) * 1e0 as n from panel)),
  s as (select {sums}, sum(dy * dy) as yy from c),
  v as (select *, {inverse} from (select *, {det} as det from s)),
  b as (select *, {slopes} from v),
  r as (select c.*, yy, b0, b1, b2, dy - b0 * d0 - b1 * d1 - b2 * d2 as e, {rows} from c, b),
  f as (select any_value(n) as n, 1 - sum(e * e) / any_value(yy) as r2, {variances} from r),
  t as (select unnest(['x2', 'x3']) as feature, unnest([b1, b2]) as coef, unnest([se1, se2]) as se, n, r2 from f),
  p as (select *, {tail_sql.normal_two_sided("coef / se")} as p from t),
  q as (select *, least(case when p = max(p) over () then p else least(2 * p, max(p) over ()) end, 1) as q from p)
  select feature, 'y' as outcome, round(coef, 10) as coefficient, round(se, 10) as std_error, round(coef / se, 4) as statistic, round(p, 8) as p_value,
         cast(n as bigint) as n, round(r2, 8) as r2, round(1 - (1 - r2) * (n - 1) / (n - 4), 8) as adj_r2, round(q, 8) as p_value_fdr,
         q <= 5e-2 as significant_fdr,
         case when q < 1e-2 then '***' when q < 5e-2 then '**' when q < 1e-1 then '*' else '' end as sig_fdr from q""")


@query("tested_coefficients", _three_sql())
def tested_coefficients(spark, d):
    out = pe.tested_coefficients(v.panel(spark, d), "y", ["x1"], ["x2", "x3"])
    out = _round(_round(out, "coefficient", "std_error", digits=10), "statistic", digits=4)
    return _round(out, "p_value", "r2", "adj_r2", "p_value_fdr", digits=8)


@query("outcome_panel", with_views("""
  with l as (select f.accession_number, f.ticker, f.filing_date, arg_min(l.permno, start_date) as permno
             from filing f join link l using (ticker) where start_date <= filing_date and filing_date <= end_date group by all)
  select l.accession_number, l.ticker, l.filing_date, l.permno,
         round(sum(abret) filter (r.date - l.filing_date between -1 and 1), 6) as car_minus1_plus1,
         round(sum(abret) filter (r.date - l.filing_date between 2 and 30), 6) as drift_30d
  from l left join abnormal r on r.permno = l.permno and r.date - l.filing_date between -30 and 90
  group by 1, 2, 3, 4"""))
def outcome_panel(spark, d):
    out = pe.outcome_panel(v.filing(spark, d), v.link(spark, d), v.daily(spark, d), v.market(spark, d))
    return _round(out.select("accession_number", "ticker", "filing_date", "permno", "car_minus1_plus1", "drift_30d"),
                  "car_minus1_plus1", "drift_30d")


@query("encoder_training")
def encoder_training(spark, d):
    """Loss per epoch of one encoder fitted on all embeddings."""
    e = v.sentence_embedding(spark, d)
    model = tr.KSparseEncoder(m=64, k=8, lr=1e-2, epochs=4, batch=64, shards=2).fit(e, _KEY)
    return model.loss_log


_STEP_M, _STEP_K, _STEP_LR, _STEP_SHARDS = 6, 2, 0.01, 2


def _loss_sql(n, weights):
    """Tables of one pass over all rows: codes z, gaps, and the loss per shard; ``weights``: table of j, we, b, wd, and of i, c."""
    return f"""
  z{n} as (select key, shard, x, j, wd, greatest(list_inner_product(x, we) + b, 0) as z0 from s, {weights}),
  t{n} as (select *, case when row_number() over (partition by key order by z0 desc, j) <= {_STEP_K} then z0 else 0e0 end as z from z{n}),
  g{n} as (select key, shard, i, sum(z * wd[i]) + any_value(c) - any_value(x[i]) as gap, any_value(x[i]) as xi
           from t{n}, c_{weights} group by key, shard, i),
  l{n} as (select shard, avg(gap * gap) as loss, count(distinct key) as n from g{n} group by shard)"""


@query("encoder_first_steps", with_views(f"""
  with s as (select *, cast('0x' || substr(md5('0|' || key), 1, 8) as bigint) % {_STEP_SHARDS} as shard from (
               select concat_ws('|', accession_number, sentence_id, item_type) as key,
                      list_transform(embedding, lambda e: cast(e as double)) as x from sentence_embedding)),
  w0 as (select range as j, list_transform(range(1, {v.ENCODER_DIM} + 1), lambda i: sin((range + 1) * i)) as we, 0e0 as b,
                list_transform(range(1, {v.ENCODER_DIM} + 1), lambda i: cos((range + 1) * i) / 10) as wd from range({_STEP_M})),
  c_w0 as (select range as i, 0e0 as c from range(1, {v.ENCODER_DIM} + 1)), {_loss_sql(0, "w0")},
  q as (select key, shard, i, 2 * gap / (n * {v.ENCODER_DIM}) as g, xi from g0 join l0 using (shard)),
  dz as (select key, shard, j, z, case when z > 0 then sum(g * wd[i]) else 0 end as d from t0 join q using (key, shard) group by key, shard, j, z),
  grads as (select shard, j, i, sum(d * xi) as ge, sum(z * g) as gd from dz join q using (key, shard) group by shard, j, i),
  gb as (select shard, j, sum(d) as g from dz group by shard, j),
  gc as (select shard, i, sum(g) as g from q group by shard, i),
  total as (select sum(n) as n_all from l0),
  w1 as (select j, list(e order by i) as we, any_value(b) as b, list(d order by i) as wd from (
           select j, i, sum(n * (we[i] - {_STEP_LR} * ge / (abs(ge) + 1e-8))) / any_value(n_all) as e,
                  sum(n * (wd[i] - {_STEP_LR} * gd / (abs(gd) + 1e-8))) / any_value(n_all) as d
           from grads join l0 using (shard) join w0 using (j), total group by j, i)
         join (select j, sum(n * (0 - {_STEP_LR} * g / (abs(g) + 1e-8))) / any_value(n_all) as b from gb join l0 using (shard), total group by j) using (j)
         group by j),
  c_w1 as (select i, sum(n * (0 - {_STEP_LR} * g / (abs(g) + 1e-8))) / any_value(n_all) as c from gc join l0 using (shard), total group by i),
  {_loss_sql(1, "w1")}
  select 1 as epoch, round(sum(n * loss) / sum(n), 8) as loss from l0 union all select 2, round(sum(n * loss) / sum(n), 8) from l1"""))
def encoder_first_steps(spark, d):
    """Loss before and after one step of two shards, from weights in closed form."""
    j, i = np.arange(1, _STEP_M + 1)[:, None], np.arange(1, v.ENCODER_DIM + 1)[None, :]
    start = cp.EncoderWeights(np.sin(j * i), np.zeros(_STEP_M), np.cos(j * i) / 10, np.zeros(v.ENCODER_DIM))
    fit = tr.KSparseEncoder(_STEP_M, _STEP_K, _STEP_LR, 2, 1 << 30, shards=_STEP_SHARDS, start=start)
    return _round(fit.fit(v.sentence_embedding(spark, d), _KEY).loss_log.select("epoch", "loss"), "loss", digits=8)


@query("encoder_ensemble")
def encoder_ensemble(spark, d):
    """Stability of the features of a small ensemble trained on filing bootstraps."""
    e = v.sentence_embedding(spark, d)
    models, _ = tr.fit_ensemble(e, _KEY, [32], [4], 3, lr=1e-2, epochs=2, batch=64, shards=2)
    return sb.stability_summary(models, sb.replica_similarity(models), 0.3)


@query("loss_plateau_stream", oracle_sql()["loss_plateau"])
def loss_stream(spark, d):
    """The plateau check as a stream over the events folder, run to the end of the data."""
    place = f"{shared_folder(spark)}/loss-{uuid.uuid4().hex}"
    events = v.table(spark, d, "events")
    log = (
        spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
        .select(F.col("user_id").alias("run"), "ts", "event_id", F.col("value").alias("loss"))
    )
    loss_plateau_stream(log, f"{place}/out", f"{place}/state", ["run"], ["ts", "event_id"], available_now=True
                        ).awaitTermination()
    return _round(latest_status(spark, f"{place}/out"), "improvement", "last10_mean", "last10_std")
