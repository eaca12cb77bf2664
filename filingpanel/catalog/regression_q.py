"""Registered queries: panel models and inference (section H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import homotopy as hy, moments as mo, regression as rg, results as rs
from . import lasso_sql, tail_sql, views as v
from .registry import query
from .views import with_views


def _round(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


_X = ["x1", "x2", "x3"]


@query("moments", with_views("""
  select year, i, j, round(sum(a[i + 1] * a[j + 1]) / 11, 4) as value
  from (select year, [1e0, x1, x2, x3, y] as a from panel),
       (select cast(range as int) as i from range(5)), (select cast(range as int) as j from range(5))
  group by all"""))
def moments(spark, d):
    m = mo.moments(v.panel(spark, d), _X, "y", ["year"])
    return _round(m.select("year", "i", F.posexplode("row").alias("j", "value")).withColumn("value", F.col("value") / 11),
                  "value", digits=4)


_STD = "(coalesce({0}, 0) - (select avg(coalesce({0}, 0)) from {1})) / (select stddev_pop(coalesce({0}, 0)) from {1})"


@query("standardize", with_views(f"""
  with gaps as (select l_orderkey, l_linenumber, l_partkey, year, case when x1 > 5 then x1 end as x1, x2 from panel),
       train as (select * from gaps where year < 1999)
  select l_orderkey, l_linenumber, l_partkey, round({_STD.format('x1', 'train')}, 6) as x1,
         round({_STD.format('x2', 'train')}, 6) as x2 from gaps"""))
def standardize(spark, d):
    p = v.panel(spark, d).withColumn("x1", F.when(F.col("x1") > 5, F.col("x1")))
    p = p.select("l_orderkey", "l_linenumber", "l_partkey", "year", "x1", "x2")
    out = rg.Standardize(["x1", "x2"]).fit(p.where("year < 1999")).transform(p)
    return _round(out.drop("year"), "x1", "x2")


# Two regressors: slopes from centred sums; g1, g2, gc are the influence of a row on each coefficient.
_OLS = """
  c as (select p.*, x1 - m1 as d1, x2 - m2 as d2, y - my as dy, m1, m2, my, n from panel p,
          (select avg(x1) as m1, avg(x2) as m2, avg(y) as my, count(*) * 1e0 as n from panel)),
  s as (select sum(d1 * d1) as s11, sum(d1 * d2) as s12, sum(d2 * d2) as s22, sum(d1 * dy) as t1, sum(d2 * dy) as t2,
               sum(dy * dy) as yy from c),
  b as (select *, (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) as b1,
               (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) as b2 from s),
  r as (select c.*, b1, b2, my - b1 * m1 - b2 * m2 as b0, yy, dy - b1 * d1 - b2 * d2 as e,
               (d1 * s22 - d2 * s12) / (s11 * s22 - s12 * s12) as g1,
               (d2 * s11 - d1 * s12) / (s11 * s22 - s12 * s12) as g2 from c, b),
  q as (select *, 1 / n - m1 * g1 - m2 * g2 as gc from r)"""
_TERMS = """
  select term, round(coef, 10) as coefficient, round(se, 10) as std_error, round(coef / se, 4) as statistic, round(%s, 8) as p_value,
         cast(n as bigint) as n, round(r2, 8) as r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 8) as adj_r2
  from (select unnest(['const', 'x1', 'x2']) as term, unnest([b0, b1, b2]) as coef, unnest([sc, s1, s2]) as se, n, r2
        from fit)"""


_NORMAL_TERMS, _T_TERMS = _TERMS % tail_sql.normal_two_sided("coef / se"), _TERMS % tail_sql.t_two_sided("coef / se", "(n - 3)")


def _fit_table(fit, spark):
    out = _round(fit.table(spark), "coefficient", "std_error", digits=10)
    return _round(_round(out, "r2", "adj_r2", "p_value", digits=8), "statistic", digits=4)


@query("ols_robust", with_views(f"""with {_OLS},
  fit as (select any_value(b0) as b0, any_value(b1) as b1, any_value(b2) as b2, any_value(n) as n,
            1 - sum(e * e) / any_value(yy) as r2, sqrt(sum(e*e*gc*gc) * any_value(n) / (any_value(n) - 3)) as sc,
            sqrt(sum(e*e*g1*g1) * any_value(n) / (any_value(n) - 3)) as s1,
            sqrt(sum(e*e*g2*g2) * any_value(n) / (any_value(n) - 3)) as s2 from q) {_NORMAL_TERMS}"""))
def ols_robust(spark, d):
    return _fit_table(rg.ols(v.panel(spark, d), "y", ["x1", "x2"]), spark)


@query("ols_classic", with_views(f"""with {_OLS},
  fit as (select any_value(b0) as b0, any_value(b1) as b1, any_value(b2) as b2, any_value(n) as n,
            1 - sum(e * e) / any_value(yy) as r2, sqrt(sum(e * e) / (any_value(n) - 3) * sum(gc*gc)) as sc,
            sqrt(sum(e * e) / (any_value(n) - 3) * sum(g1*g1)) as s1,
            sqrt(sum(e * e) / (any_value(n) - 3) * sum(g2*g2)) as s2 from q) {_T_TERMS}"""))
def ols_classic(spark, d):
    return _fit_table(rg.ols(v.panel(spark, d), "y", ["x1", "x2"], cov="classic"), spark)


@query("ols_clustered", with_views(f"""with {_OLS},
  g as (select cik, sum(e * gc) as uc, sum(e * g1) as u1, sum(e * g2) as u2 from q group by cik),
  k as (select count(*) * 1e0 as k, sum(uc*uc) as vc, sum(u1*u1) as v1, sum(u2*u2) as v2 from g),
  f as (select any_value(b0) as b0, any_value(b1) as b1, any_value(b2) as b2, any_value(n) as n,
               1 - sum(e * e) / any_value(yy) as r2 from q),
  fit as (select f.*, sqrt(vc * k / (k - 1) * (n - 1) / (n - 3)) as sc, sqrt(v1 * k / (k - 1) * (n - 1) / (n - 3)) as s1,
                 sqrt(v2 * k / (k - 1) * (n - 1) / (n - 3)) as s2 from f, k) {_NORMAL_TERMS}"""))
def ols_clustered(spark, d):
    return _fit_table(rg.ols(v.panel(spark, d), "y", ["x1", "x2"], cluster="cik"), spark)


@query("compare_models", with_views(f"""with {_OLS},
  one as (select regr_r2(y, x1) as r2b from panel),
  two as (select 1 - sum(e * e) / any_value(yy) as r2f, any_value(n) as n from q),
  f as (select *, (r2f - r2b) / ((1 - r2f) / (n - 3)) as f from one, two)
  select 'y' as outcome, cast(n as bigint) as n_obs, round(r2b, 8) as r2_baseline, round(r2f, 8) as r2_full,
         round(r2f - r2b, 8) as delta_r2, round(f, 4) as f_stat, round({tail_sql.f_upper("f", "1e0", "(n - 3)")}, 7) as f_pval from f"""))
def compare_models(spark, d):
    out = rg.compare_models(v.panel(spark, d), ["y"], ["x1"], ["x2"])
    return _round(_round(_round(out, "r2_baseline", "r2_full", "delta_r2", digits=8), "f_stat", digits=4), "f_pval", digits=7)


@query("joint_f_test", with_views(f"""with {_OLS},
  w as (select any_value(b1) as b1, any_value(b2) as b2, any_value(n) as n, 1 - sum(e * e) / any_value(yy) as r2,
               sum(e*e*g1*g1) * any_value(n) / (any_value(n) - 3) as v11,
               sum(e*e*g1*g2) * any_value(n) / (any_value(n) - 3) as v12,
               sum(e*e*g2*g2) * any_value(n) / (any_value(n) - 3) as v22 from q),
  f as (select *, (b1*b1*v22 - 2*b1*b2*v12 + b2*b2*v11) / (v11*v22 - v12*v12) / 2 as f from w)
  select 2::bigint as n_features, round(f, 6) as f_statistic, round({tail_sql.f_upper("f", "2e0", "(n - 3)")}, 8) as p_value,
         round(r2, 8) as r_squared, cast(n as bigint) as n_obs from f"""))
def joint_f_test(spark, d):
    out = rg.joint_f_test(spark, rg.ols(v.panel(spark, d), "y", ["x1", "x2"]), ["x1", "x2"])
    return _round(_round(out, "r_squared", "p_value", digits=8), "f_statistic")


@query("feature_correlations", with_views(" union all ".join(
    f"select '{x}' as feature, round(corr(y, {x}), 8) as correlation from panel" for x in _X)))
def feature_correlations(spark, d):
    return _round(rg.feature_correlations(v.panel(spark, d), "y", _X), "correlation", digits=8)


def _lasso_frame(spark, d):
    """Columns with signal: price depends on quantity and part."""
    return v.panel(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", "year", F.col("x2").alias("y"), "x1", "x3",
        (F.col("y") * 10).alias("x4"), (F.col("l_partkey") % 100).cast("double").alias("x5"))


_LX = ["x1", "x3", "x4", "x5"]
_LKEY = ["l_orderkey", "l_linenumber", "l_partkey"]
_LSQL = {"x1": "x1", "x3": "x3", "x4": "y * 10", "x5": "cast(l_partkey % 100 as double)"}


def _lasso_rows(names, split="0", where="true", source="panel"):
    """Rows of the SQL: variant, fold, outcome, columns."""
    cols = ", ".join(f"{_LSQL[x]} as z{j}" for j, x in enumerate(names))
    return f"select {split} as v, {lasso_sql.fold_of(_LKEY)} as f, x2 as y, {cols} from {source} where {where}"


@query("lasso_cv", lasso_sql.lasso_sql(_lasso_rows(_LX), _LX))
def lasso_cv(spark, d):
    return _round(rg.lasso_cv(_lasso_frame(spark, d), _LX, "y", key=_LKEY).table(spark), "coefficient")


@query("lasso_cv_forced_controls", lasso_sql.lasso_sql(_lasso_rows(_LX), _LX, [1]))
def lasso_cv_forced_controls(spark, d):
    m = rg.lasso_cv(_lasso_frame(spark, d), _LX, "y", key=_LKEY, unpenalized=["x3"])
    return _round(m.table(spark), "coefficient")


@query("lasso_path_counts", lasso_sql.path_counts_sql(_lasso_rows(_LX), _LX, [0.001, 0.01, 0.1, 1.0, 10.0, 100.0], ["x3"]))
def lasso_path_counts(spark, d):
    return rg.lasso_path_counts(_lasso_frame(spark, d), _LX, "y", [0.001, 0.01, 0.1, 1.0, 10.0, 100.0], ["x3"])


@query("lasso_knots", lasso_sql.knots_sql(_lasso_rows(["x1", "x5"]), ["x1", "x5"]))
def lasso_knots(spark, d):
    """Where the columns enter, and the coefficients there."""
    out = hy.lasso_knots(_lasso_frame(spark, d), ["x1", "x5"], "y")
    b = [F.coalesce(F.col("coefficients")[x], F.lit(0.0)).alias(f"b_{x}") for x in ("x1", "x5")]
    return _round(out.select("step", "alpha", "feature", "change", *b), "alpha", "b_x1", "b_x5", digits=7)


_SEL = ["x3", "x1", "x4", "x5"]


def _selection_sql(years):
    split = f"panel, (select unnest([{', '.join(map(str, years))}]) as s)"
    return lasso_sql.selection_sql(_lasso_rows(_SEL, "s", "year < s", split), _lasso_rows(_SEL, "s", "year >= s", split), 4, [1, 2, 3], "y")


@query("feature_selection", _selection_sql([1999]))
def feature_selection(spark, d):
    out = rg.feature_selection(_lasso_frame(spark, d), ["y"], ["x1", "x4", "x5"], ["x3"], split_year=1999, key=_LKEY)
    return _round(out, "r2_train", "r2_test", "alpha", digits=7)


@query("split_sensitivity", _selection_sql([1998, 1999, 2000]))
def split_sensitivity(spark, d):
    out = rg.split_sensitivity(_lasso_frame(spark, d), "y", ["x1", "x4", "x5"], [1998, 1999, 2000], ["x3"], _LKEY)
    return _round(out, "r2_train", "r2_test", "alpha", digits=7)


@query("selected_features", with_views("""
  select feature, coefficient, p_value, outcome, round(abs(coefficient), 6) as abs_coefficient from test_result
  where abs(coefficient) > 1e-6"""))
def selected_features(spark, d):
    return _round(rg.selected_features(v.test_result(spark, d)), "abs_coefficient")


@query("r2_variance", with_views("""
  select year < 1999 as train, count(*) as n, round(1 - var_pop(x2 - 15e-1 * x1) / var_pop(x2), 6) as r2
  from panel group by 1"""))
def r2_variance(spark, d):
    p = v.panel(spark, d).withColumn("pred", F.col("x1") * 1.5).withColumn("train", F.col("year") < 1999)
    return _round(rg.r2_variance(p, "x2", "pred", ["train"]), "r2")


_FDR = """
  fdr as (select *, least(min(p_value * m / r) over (order by r rows between current row and unbounded following), 1)
            as p_value_fdr
          from (select *, row_number() over (order by p_value, feature) as r, count(*) over () as m from test_result))"""
_STARS = "case when {0} < 1e-2 then '***' when {0} < 5e-2 then '**' when {0} < 1e-1 then '*' else '' end"


@query("fdr_bh", with_views(f"""with {_FDR}
  select feature, outcome, coefficient, p_value, round(p_value_fdr, 9) as p_value_fdr,
         p_value_fdr <= 5e-2 as significant_fdr, {_STARS.format('p_value_fdr')} as sig_fdr from fdr"""))
def fdr_bh(spark, d):
    return _round(rs.fdr_bh(v.test_result(spark, d)), "p_value_fdr", digits=9)


@query("significance_counts", with_views(f"""with {_FDR}
  select outcome, count(*) as n_tests, count(*) filter (p_value < 5e-2) as n_raw,
         count(*) filter (p_value_fdr <= 2e-2) as n_fdr from fdr group by outcome"""))
def significance_counts(spark, d):
    return rs.significance_counts(rs.fdr_bh(v.test_result(spark, d), alpha=0.02))


def _named(spark, d):
    name = F.concat(F.when(F.col("feature") % 2 == 0, "mean_M1_k1_n").otherwise("freq_M1_k1_n"), F.col("feature"))
    return v.test_result(spark, d).withColumn("feature", name)


@query("coefficient_table", with_views(f"""
  select feature, 'n' || id as neuron, case when id % 2 = 0 then 'Mean' else 'Freq' end as type, coefficient, p_value,
         {_STARS.format('p_value')} as sig
  from (select feature as id, case when feature % 2 = 0 then 'mean_M1_k1_n' else 'freq_M1_k1_n' end || feature as feature,
               coefficient, p_value from test_result)
  order by abs(coefficient) desc, feature limit 15"""))
def coefficient_table(spark, d):
    return rs.coefficient_table(_named(spark, d))


_BRANDS = """
  brand as (select outcome, min(coefficient) filter (feature % 2 = 0) as beta_on,
                   min(coefficient) filter (feature % 2 = 1) * 9e-1 as beta_perp,
                   min(p_value) filter (feature % 2 = 0) as p_on, max(p_value) filter (feature % 2 = 1) as p_perp
            from test_result group by outcome)"""


@query("attention_test", with_views(f"""with {_BRANDS}
  select outcome, beta_on, beta_perp, p_on, p_perp, abs(beta_perp) < abs(beta_on) as off_pricing_weaker,
         case when abs(beta_perp) > abs(beta_on) then 'consistent' else 'inconsistent' end as verdict from brand
  union all
  select 'car_3d', sum(beta_on), sum(beta_perp), min(p_on), max(p_perp), abs(sum(beta_perp)) < abs(sum(beta_on)),
         case when abs(sum(beta_perp)) < abs(sum(beta_on)) then 'consistent' else 'inconsistent' end
  from (select round(sum(beta_on), 6) as beta_on, round(sum(beta_perp), 6) as beta_perp, min(p_on) as p_on,
               max(p_perp) as p_perp from brand)"""))
def attention_test(spark, d):
    t = v.test_result(spark, d)
    even = F.col("feature") % 2 == 0
    on = t.where(even).groupBy("outcome").agg(F.min("coefficient").alias("coefficient"), F.min("p_value").alias("p_value"))
    perp = t.where(~even).groupBy("outcome").agg(
        (F.min("coefficient") * 0.9).alias("coefficient"), F.max("p_value").alias("p_value"))
    fits = on.withColumn("term", F.lit("on")).unionByName(perp.withColumn("term", F.lit("perp")))
    car = fits.groupBy("term").agg(
        F.lit("car_3d").alias("outcome"), F.round(F.sum("coefficient"), 6).alias("coefficient"),
        F.when(F.col("term") == "on", F.min("p_value")).otherwise(F.max("p_value")).alias("p_value"))
    return rs.attention_test(fits.unionByName(car))


@query("coef_comparison", with_views("""
  select feature, coalesce(a.coefficient, 0) as coef_car, coalesce(a.p_value, 1) as pval_car,
         coalesce(b.coefficient, 0) as coef_drift, coalesce(b.p_value, 1) as pval_drift,
         abs(coalesce(b.coefficient, 0)) as abs_drift
  from (select * from test_result where p_value < 2e-2) a
  full join (select * from test_result where coefficient > 0) b using (feature)"""))
def coef_comparison(spark, d):
    t = v.test_result(spark, d)
    return rs.coef_comparison(t.where("p_value < 0.02"), t.where("coefficient > 0"))


@query("histogram", with_views("""
  select bin, round(lo + bin * (hi - lo) / 50, 6) as left_edge, count(*) as n
  from (select least(cast(floor((x2 - lo) / (hi - lo) * 50) as int), 49) as bin, lo, hi
        from panel, (select min(x2) as lo, max(x2) as hi from panel)) group by bin, lo, hi"""))
def histogram(spark, d):
    return _round(rs.histogram(v.panel(spark, d), "x2", 50), "left_edge")


@query("yearly_means", with_views("""
  select year, round(avg(x1), 9) as x1, round(avg(y), 9) as y from panel group by year"""))
def yearly_means(spark, d):
    return _round(rs.yearly_means(v.panel(spark, d), ["x1", "y"]), "x1", "y", digits=9)


@query("summary_stats", with_views(" union all ".join(f"""
  select '{c}' as "column", count({c}) as n, round(avg({c}), 9) as mean, round(stddev_samp({c}), 6) as std,
         min({c}) as min, max({c}) as max, round(quantile_cont({c}, 25e-2), 6) as q25,
         round(quantile_cont({c}, 5e-1), 6) as q50, round(quantile_cont({c}, 75e-2), 6) as q75 from panel"""
    for c in ("y", "x1", "x2"))))
def summary_stats(spark, d):
    out = _round(rs.summary_stats(v.panel(spark, d), ["y", "x1", "x2"]), "std", "q25", "q50", "q75")
    return _round(out, "mean", digits=9)


@query("column_profile", with_views(
    "with gaps as (select y, case when x1 > 5 then x1 end as x1, x3 from panel)" + " union all ".join(f"""
  select '{c}' as "column", round(avg({c}), 9) as mean, round(stddev_samp({c}), 6) as std, min({c}) as min,
         max({c}) as max, count(*) - count({c}) as n_null,
         round(count(*) filter ({c} <> 0) * 1e0 / count(*), 6) as nonzero_share from gaps""" for c in ("y", "x1", "x3"))))
def column_profile(spark, d):
    p = v.panel(spark, d).withColumn("x1", F.when(F.col("x1") > 5, F.col("x1")))
    return _round(_round(rs.column_profile(p, ["y", "x1", "x3"]), "std", "nonzero_share"), "mean", digits=9)


@query("normality_share", with_views(" union all ".join(f"""
  select '{c}' as "column", round(w1, 6) as within_1, round(w2, 6) as within_2,
         case when w1 > 65e-2 and w1 < 71e-2 and w2 > 93e-2 and w2 < 97e-2 then 'looks like random noise'
              else 'deviates from normal' end as verdict
  from (select avg(case when abs(({c} - m) / s) <= 1 then 1e0 else 0e0 end) as w1,
               avg(case when abs(({c} - m) / s) <= 2 then 1e0 else 0e0 end) as w2
        from panel, (select avg({c}) as m, stddev_pop({c}) as s from panel))""" for c in ("x1", "x2"))))
def normality_share(spark, d):
    return _round(rs.normality_share(v.panel(spark, d), ["x1", "x2"]), "within_1", "within_2")


@query("top_correlations", with_views("select feature, round(c, 8) as correlation, round(abs(c), 8) as abs_correlation from (" + " union all ".join(
    f"select '{x}' as feature, corr(y, {x}) as c from panel" for x in _X) + ") order by abs(c) desc limit 2"))
def top_correlations(spark, d):
    out = rs.top_correlations(rg.feature_correlations(v.panel(spark, d), "y", _X), 2)
    return _round(out, "correlation", "abs_correlation", digits=8)


@query("correlation_summary", with_views("select round(max(abs(c)), 8) as max_abs, round(avg(abs(c)), 8) as mean_abs, round(median(abs(c)), 8) as median_abs from (" + " union all ".join(
    f"select corr(y, {x}) as c from panel" for x in _X) + ")"))
def correlation_summary(spark, d):
    out = rs.correlation_summary(rg.feature_correlations(v.panel(spark, d), "y", _X))
    return _round(out, "max_abs", "mean_abs", "median_abs", digits=8)


@query("feature_overlap", with_views("""
  select feature, case when p_value < 2e-2 and coefficient > 0 then 'both' when p_value < 2e-2 then 'first only'
                       else 'second only' end as found_in
  from test_result where p_value < 2e-2 or coefficient > 0"""))
def feature_overlap(spark, d):
    t = v.test_result(spark, d)
    return rs.feature_overlap(t.where("p_value < 0.02"), t.where("coefficient > 0"))


@query("complete_cases", with_views("""
  select record_id, lt, ceq from fundamental where lt is not null and ceq is not null"""))
def complete_cases(spark, d):
    return rs.complete_cases(v.fundamental(spark, d), ["lt", "ceq"]).select("record_id", "lt", "ceq")


@query("grade", with_views("""
  select feature, p_value, case when p_value < 1e-2 then 'significant at 1%' when p_value < 5e-2 then 'significant at 5%'
    when p_value < 1e-1 then 'marginal at 10%' else 'not significant' end as grade
  from (select feature, p_value * 4 as p_value from test_result)"""))
def grade(spark, d):
    t = v.test_result(spark, d).select("feature", (F.col("p_value") * 4).alias("p_value"))
    return rs.grade(t, "p_value")


@query("control_sign_check", with_views("""
  select feature, term, coefficient, expected, case when expected = 0 then 'open'
         when sign(coefficient) = expected then 'as expected' else 'opposite' end as verdict
  from (select feature, coefficient, (['size','bm','past_ret','past_vol','leverage','const'])[cast(feature % 6 as int) + 1]
          as term, ([-1, 1, 1, -1, 0, 9])[cast(feature % 6 as int) + 1] as expected from test_result)
  where term <> 'const'"""))
def control_sign_check(spark, d):
    names = F.array(*[F.lit(x) for x in ("size", "bm", "past_ret", "past_vol", "leverage", "const")])
    t = v.test_result(spark, d).select(
        "feature", F.element_at(names, (F.col("feature") % 6 + 1).cast("int")).alias("term"), "coefficient")
    return rs.control_sign_check(t)
