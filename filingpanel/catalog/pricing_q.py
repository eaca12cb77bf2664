"""Registered queries: pricing function and decomposition (section H, second part)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pricing as pr
from ..operators.sampling import firm_folds
from . import views as v
from .registry import query
from .views import with_views

_XS = ["x1", "x3"]
_KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
_ALPHA = 2.0


def _round(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


def _frame(spark, d):
    p = firm_folds(v.panel(spark, d), 5)
    return p.withColumn("z", F.array("x1", "x3")).withColumn(
        "item_type", F.element_at(F.array(F.lit("item1"), F.lit("item7")), (F.col("l_linenumber") % 2 + 1).cast("int")))


def _forward(spark, d):
    df = _frame(spark, d)
    return df, pr.pricing_forward(df, _XS, "y", alphas=(_ALPHA,), key=_KEY)


_P = """
  p as (select *, (['item1', 'item7'])[l_linenumber % 2 + 1] as item_type from panel join (
          select cik, cast((row_number() over (order by md5('42|' || cik)) - 1) % 5 as int) as fold
          from (select distinct cik from panel)) using (cik))"""
_SUMS = """count(*) * 1e0 as n, avg(x1) as m1, avg(x3) as m2, avg(y) as my, var_pop(x1) as v11, var_pop(x3) as v22,
    covar_pop(x1, x3) as v12, covar_pop(x1, y) as c1, covar_pop(x3, y) as c2"""


def _solve(source, d1="sqrt(v11)", d2="sqrt(v22)", extra=""):
    """Ridge on two scaled columns: (S + alpha I) b = t, weights b / scale."""
    return f"""
  {source}_s as (select *, n * v11 / ({d1} * {d1}) + {_ALPHA}e0 as a, n * v12 / ({d1} * {d2}) as b,
              n * v22 / ({d2} * {d2}) + {_ALPHA}e0 as c, n * c1 / {d1} as t1, n * c2 / {d2} as t2,
              {d1} as d1, {d2} as d2 from {source}{extra}),
  {source}_w as (select *, (t1 * c - t2 * b) / (a * c - b * b) / d1 as w1, (t2 * a - t1 * b) / (a * c - b * b) / d2 as w2
           from {source}_s),
  {source}_m as (select *, my - w1 * m1 - w2 * m2 as w0 from {source}_w)"""


_POOL = f"{_P}, pool as (select f as fold, {_SUMS} from p, (select cast(range as int) as f from range(5)) where p.fold <> f group by f)"
_FWD = f"""{_P}, fwd as (select t as year, f as fold, {_SUMS} from p, (select distinct year as t, fold as f from p)
  where p.year < t and p.fold <> f group by t, f having count(*) >= 10)"""
_FWD_M = _FWD + "," + _solve("fwd")


def _flat(w):
    w = w.select("year", "fold", "intercept", F.col("weights")[0].alias("w1"), F.col("weights")[1].alias("w2"), "n_train")
    return _round(w, "intercept", "w1", "w2", digits=9)


@query("pricing_pooled_fixed", with_views(f"""with {_POOL}, {_solve('pool')}
  select -1 as year, fold, round(w0, 9) as intercept, round(w1, 9) as w1, round(w2, 9) as w2, cast(n as bigint) as n_train
  from pool_m"""))
def pricing_pooled_fixed(spark, d):
    return _flat(pr.pricing_pooled(_frame(spark, d), _XS, "y", alphas=(_ALPHA,), key=_KEY))


@query("pricing_pooled_global_scale", with_views(f"""with {_POOL},
  g as (select stddev_pop(x1) as g1, stddev_pop(x3) as g2 from p), {_solve('pool', 'g1', 'g2', ', g')}
  select -1 as year, fold, round(w0, 9) as intercept, round(w1, 9) as w1, round(w2, 9) as w2, cast(n as bigint) as n_train
  from pool_m"""))
def pricing_pooled_global_scale(spark, d):
    return _flat(pr.pricing_pooled(_frame(spark, d), _XS, "y", alphas=(_ALPHA,), scaling="all", key=_KEY))


@query("pricing_forward_fixed", with_views(f"""with {_FWD_M}
  select year, fold, round(w0, 9) as intercept, round(w1, 9) as w1, round(w2, 9) as w2, cast(n as bigint) as n_train
  from fwd_m"""))
def pricing_forward_fixed(spark, d):
    return _flat(_forward(spark, d)[1])


# The first is the package's own path for panels of named columns, the other one keeps the matrices in tiles.
@query("pricing_forward_tiles", with_views(f"""with {_FWD_M}
  select year, fold, round(w0, 9) as intercept, round(w1, 9) as w1, round(w2, 9) as w2, cast(n as bigint) as n_train
  from fwd_m"""))
def pricing_forward_tiles(spark, d):
    return _flat(pr.pricing_forward(_frame(spark, d), "z", "y", alphas=(_ALPHA,), key=_KEY))


@query("pricing_pooled_tiles_global_scale", with_views(f"""with {_POOL},
  g as (select stddev_pop(x1) as g1, stddev_pop(x3) as g2 from p), {_solve('pool', 'g1', 'g2', ', g')}
  select -1 as year, fold, round(w0, 9) as intercept, round(w1, 9) as w1, round(w2, 9) as w2, cast(n as bigint) as n_train
  from pool_m"""))
def pricing_pooled_tiles_global_scale(spark, d):
    return _flat(pr.pricing_pooled(_frame(spark, d), "z", "y", alphas=(_ALPHA,), scaling="all", key=_KEY))


def _chosen(train, keys):
    """Ridge with the alpha of the best mean R2 over three inner folds; ``train``: rows of each training set, with ``keys``."""
    k = ", ".join(keys)
    same = " and ".join(f"r.{x} = h.{x}" for x in keys)
    moments = """count(*) * 1e0 as n, avg(x1) as m1, avg(x3) as m2, avg(y) as my, var_pop(x1) as v11, var_pop(x3) as v22,
    covar_pop(x1, x3) as v12, covar_pop(x1, y) as c1, covar_pop(x3, y) as c2, var_pop(y) as vy"""
    ridge = """(c1 / d1 * (n * v22 / (d2 * d2) + alpha) - c2 / d2 * n * v12 / (d1 * d2)) * n
      / ((n * v11 / (d1 * d1) + alpha) * (n * v22 / (d2 * d2) + alpha) - (n * v12 / (d1 * d2)) ** 2) / d1 as w1,
    (c2 / d2 * (n * v11 / (d1 * d1) + alpha) - c1 / d1 * n * v12 / (d1 * d2)) * n
      / ((n * v11 / (d1 * d1) + alpha) * (n * v22 / (d2 * d2) + alpha) - (n * v12 / (d1 * d2)) ** 2) / d2 as w2"""
    return f"""
  inner_p as (select *, cast(cast('0x' || substr(md5('7|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey), 1, 8) as bigint) % 3 as int) as i
              from p),
  train as ({train}),
  whole as (select {k}, {moments}, sqrt(var_pop(x1)) as d1, sqrt(var_pop(x3)) as d2 from train group by {k} having count(*) >= 10),
  held as (select {k}, i, {moments} from train group by {k}, i),
  rest as (select {", ".join(f"t.{x}" for x in keys)}, j.i, {moments} from train t, (select range as i from range(3)) j
           where t.i <> j.i group by {", ".join(f"t.{x}" for x in keys)}, j.i),
  grid as (select 10e0 ** (-3 + 6e0 * range / 49) as alpha from range(50)),
  fits as (select r.*, alpha, {ridge} from (select * from rest join (select {k}, d1, d2 from whole) using ({k})) r, grid),
  scores as (select {", ".join(f"r.{x}" for x in keys)}, alpha, avg(1 - ((h.vy - 2 * w1 * h.c1 - 2 * w2 * h.c2 + w1 * w1 * h.v11
                 + 2 * w1 * w2 * h.v12 + w2 * w2 * h.v22) + (h.my - r.my - w1 * (h.m1 - r.m1) - w2 * (h.m2 - r.m2)) ** 2) / h.vy) as score
             from fits r join held h on {same} and r.i = h.i group by {", ".join(f"r.{x}" for x in keys)}, alpha),
  best as (select {k}, arg_max(alpha, score) as alpha from scores group by {k}),
  final as (select w.*, {ridge}, alpha from whole w join best using ({k}))
  select {"-1 as year, fold" if "year" not in keys else "year, fold"}, round(my - w1 * m1 - w2 * m2, 9) as intercept, round(w1, 9) as w1,
         round(w2, 9) as w2, round(alpha, 9) as alpha, cast(n as bigint) as n_train from final"""


def _chosen_flat(w):
    return _round(w.select("year", "fold", "intercept", F.col("weights")[0].alias("w1"), F.col("weights")[1].alias("w2"), "alpha", "n_train"),
                  "intercept", "w1", "w2", "alpha", digits=9)


@query("pricing_pooled_cv", with_views(f"with {_P}, " + _chosen(
    "select f as fold, i, y, x1, x3 from inner_p, (select cast(range as int) as f from range(5)) where inner_p.fold <> f", ["fold"])))
def pricing_pooled_cv(spark, d):
    return _chosen_flat(pr.pricing_pooled(_frame(spark, d), _XS, "y", key=_KEY))


@query("pricing_forward_cv", with_views(f"with {_P}, " + _chosen(
    """select t as year, f as fold, i, y, x1, x3 from inner_p, (select distinct year as t, fold as f from p)
       where inner_p.year < t and inner_p.fold <> f""", ["year", "fold"])))
def pricing_forward_cv(spark, d):
    return _chosen_flat(pr.pricing_forward(_frame(spark, d), _XS, "y", key=_KEY))


@query("pricing_weights", with_views(f"""with {_FWD_M}
  select year, fold, 'x1' as feature, round(w1, 9) as weight from fwd_m
  union all select year, fold, 'x3', round(w2, 9) from fwd_m"""))
def pricing_weights(spark, d):
    return _round(pr.pricing_weights(_forward(spark, d)[1], _XS), "weight", digits=9)


_PRED = f"{_FWD_M}, pred as (select p.*, w1, w2, w0 + w1 * x1 + w2 * x3 as prediction from p left join fwd_m using (year, fold))"


@query("pricing_predictions", with_views(f"""with {_PRED}
  select l_orderkey, l_linenumber, l_partkey, round(prediction, 8) as prediction from pred"""))
def pricing_predictions(spark, d):
    return _round(pr.predict(*_forward(spark, d)).select(*_KEY, "prediction"), "prediction", digits=8)


@query("fit_quality", with_views(f"""with {_PRED}
  select count(prediction) as n, round(1 - sum((y - prediction) ** 2) / sum((y - m) ** 2), 8) as r2,
         round(corr(y, prediction), 8) as correlation, round(sqrt(avg((y - prediction) ** 2)), 8) as rmse
  from pred, (select avg(y) as m from pred where prediction is not null) where prediction is not null"""))
def fit_quality(spark, d):
    return _round(pr.fit_quality(pr.predict(*_forward(spark, d)), "y"), "r2", "correlation", "rmse", digits=8)


@query("fit_quality_zero_filled", with_views(f"""with {_PRED}
  select count(*) as n, round(1 - sum((y - coalesce(prediction, 0)) ** 2) / sum((y - m) ** 2), 8) as r2,
         round(corr(y, coalesce(prediction, 0)), 8) as correlation,
         round(sqrt(avg((y - coalesce(prediction, 0)) ** 2)), 8) as rmse
  from pred, (select avg(y) as m from pred)"""))
def fit_quality_zero_filled(spark, d):
    return _round(pr.fit_quality(pr.predict(*_forward(spark, d), fill=0.0), "y"), "r2", "correlation", "rmse", digits=8)


_ON = "(x1 * w1 + x3 * w2) / (w1 * w1 + w2 * w2)"


@query("decompose", with_views(f"""with {_PRED}
  select l_orderkey, l_linenumber, l_partkey, round({_ON} * w1, 5) as on1, round({_ON} * w2, 5) as on2,
         round(x1 - {_ON} * w1, 5) as perp1, round(x3 - {_ON} * w2, 5) as perp2 from pred"""))
def decompose(spark, d):
    out = pr.decompose(*_forward(spark, d))
    return _round(out.select(*_KEY, F.col("z_on")[0].alias("on1"), F.col("z_on")[1].alias("on2"),
                             F.col("z_perp")[0].alias("perp1"), F.col("z_perp")[1].alias("perp2")),
                  "on1", "on2", "perp1", "perp2", digits=5)


@query("check_decomposition", with_views(f"""with {_PRED}
  select count(w1) as n, 0e0 as max_error, true as ok from pred"""))
def check_decomposition(spark, d):
    return _round(pr.check_decomposition(pr.decompose(*_forward(spark, d))), "max_error")


_DELTA = """
  delta as (select *, x1 - lag(x1) over w as e1, x3 - lag(x3) over w as e2 from pred
            window w as (partition by cik, item_type order by filing_date, l_orderkey, l_linenumber, l_partkey, x1, x3))"""
_ORDER = ["filing_date", *_KEY, "x1", "x3"]


def _changes(spark, d):
    df, w = _forward(spark, d)
    return pr.firm_diff(df, order=_ORDER), w


@query("firm_diff", with_views(f"""with {_PRED}, {_DELTA}
  select l_orderkey, l_linenumber, l_partkey, round(e1, 6) as d1, round(e2, 6) as d2 from delta"""))
def firm_diff(spark, d):
    out = pr.firm_diff(_frame(spark, d), order=_ORDER)
    return _round(out.select(*_KEY, F.col("delta_z")[0].alias("d1"), F.col("delta_z")[1].alias("d2")), "d1", "d2")


@query("priced_change", with_views(f"""with {_PRED}, {_DELTA}
  select l_orderkey, l_linenumber, l_partkey, round(e1 * w1 + e2 * w2, 8) as priced_change from delta"""))
def priced_change(spark, d):
    return _round(pr.priced_change(*_changes(spark, d)).select(*_KEY, "priced_change"), "priced_change", digits=8)


_C = "(e1 * w1 + e2 * w2) / (w1 * w1 + w2 * w2)"
_NORMS = f"""
  norms as (select *, e1 * w1 + e2 * w2 as priced_change,
                   ({_C} * w1) ** 2 + ({_C} * w2) ** 2 as norm_priced_squared,
                   (e1 - {_C} * w1) ** 2 + (e2 - {_C} * w2) ** 2 as norm_orthogonal_squared from delta)"""


@query("change_norms", with_views(f"""with {_PRED}, {_DELTA}, {_NORMS}
  select l_orderkey, l_linenumber, l_partkey, round(norm_priced_squared, 4) as norm_priced_squared,
         round(norm_orthogonal_squared, 4) as norm_orthogonal_squared, round(sqrt(norm_priced_squared), 4) as norm_priced,
         round(sqrt(norm_orthogonal_squared), 4) as norm_orthogonal from norms"""))
def change_norms(spark, d):
    cols = ["norm_priced_squared", "norm_orthogonal_squared", "norm_priced", "norm_orthogonal"]
    return _round(pr.change_norms(*_changes(spark, d)).select(*_KEY, *cols), *cols, digits=4)


@query("change_norms_filled", with_views(f"""with {_PRED}, {_DELTA}, {_NORMS}
  select l_orderkey, l_linenumber, l_partkey, round(coalesce(sqrt(norm_priced_squared), 0), 4) as norm_priced,
         round(coalesce(sqrt(norm_orthogonal_squared), 0), 4) as norm_orthogonal from norms"""))
def change_norms_filled(spark, d):
    out = pr.change_norms(*_changes(spark, d), fill=0.0).select(*_KEY, "norm_priced", "norm_orthogonal")
    return _round(out, "norm_priced", "norm_orthogonal", digits=4)


@query("pricing_summary", with_views(f"""with {_PRED}, {_DELTA}, {_NORMS}
  select count(*) as n_documents, 2 as n_features,
         round(1 - sum((y - prediction) ** 2) / any_value(ss), 8) as r2, round(corr(y, prediction), 8) as correlation,
         round(avg(priced_change), 8) as mean_priced_change, round(sqrt(avg(norm_priced_squared)), 6) as rms_priced,
         round(sqrt(avg(norm_orthogonal_squared)), 6) as rms_orthogonal,
         round(sqrt(avg(norm_orthogonal_squared)) / sqrt(avg(norm_priced_squared)), 6) as ratio
  from norms, (select var_pop(y) * count(*) as ss from norms where prediction is not null)"""))
def pricing_summary(spark, d):
    df, w = _changes(spark, d)
    out = pr.change_norms(pr.priced_change(pr.predict(df, w), w), w)
    out = pr.pricing_summary(out, "y", len(_XS))
    out = _round(out, "r2", "correlation", "mean_priced_change", digits=8)
    return _round(out, "rms_priced", "rms_orthogonal", "ratio")
