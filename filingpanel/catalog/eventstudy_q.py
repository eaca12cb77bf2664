"""Registered queries: event study, links and controls (section G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import controls as ct, eventstudy as es
from . import views as v
from .registry import query
from .views import with_views


def _round(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


def _abnormal(spark, d):
    return es.abnormal_returns(v.daily(spark, d), v.market(spark, d))


@query("link_asof_interval", with_views("""
  select accession_number, ticker, filing_date, arg_min(l.permno, start_date) as permno
  from filing f join link l using (ticker)
  where start_date <= filing_date and filing_date <= end_date group by all"""))
def link_asof_interval(spark, d):
    return es.link_asof_interval(v.filing(spark, d), v.link(spark, d))


@query("link_equi", with_views("""
  select accession_number, f.cik, filing_date, ticker, l.permno from (select permno as cik, * exclude (permno) from filing) f
  join (select distinct permno as cik, gvkey as permno from link) l using (cik)"""))
def link_equi(spark, d):
    links = v.link(spark, d).select(F.col("permno").alias("cik"), F.col("gvkey").alias("permno"))
    return es.link_equi(v.filing(spark, d).withColumnRenamed("permno", "cik"), links)


@query("link_open_interval", with_views("""
  select accession_number, permno, ticker, filing_date, gvkey from filing f left join (
    select permno, filing_date, arg_min(gvkey, start_date) as gvkey
    from (select distinct permno, filing_date from filing) join link using (permno)
    where start_date <= filing_date and filing_date <= coalesce(end_date, date '2099-12-31') group by all)
  using (permno, filing_date)"""))
def link_open_interval(spark, d):
    return es.link_open_interval(v.filing(spark, d), v.link(spark, d))


@query("abnormal_returns", with_views("""
  select permno, date, round(ret, 9) as ret, round(mkt_ret, 9) as mkt_ret, round(ret - mkt_ret, 9) as abret
  from (select * replace (case when vol > 1 then ret end as ret) from daily) left join market using (date)"""))
def abnormal_returns(spark, d):
    text = F.when(F.col("vol") > 1, F.col("ret").cast("string")).otherwise(F.lit("C"))
    out = es.abnormal_returns(v.daily(spark, d).withColumn("ret", text), v.market(spark, d))
    return _round(out.select("permno", "date", "ret", "mkt_ret", "abret"), "ret", "mkt_ret", "abret", digits=9)


def _window_sql(cols, lo, hi):
    return f"""select f.permno, f.filing_date, {cols}
      from (select distinct permno, filing_date from filing) f
      left join (select *, date as dd from abnormal) r
        on r.permno = f.permno and r.date - f.filing_date between {lo} and {hi}
      group by f.permno, f.filing_date"""


_OFF = "(r.date - f.filing_date)"


def _sum_in(lo, hi, name):
    return f"round(sum(abret) filter ({_OFF} between {lo} and {hi}), 6) as {name}"


_VOLUME = f"""round(case when avg(vol) filter ({_OFF} between -10 and -1) > 0
  then max(vol) filter ({_OFF} = 0) / avg(vol) filter ({_OFF} between -10 and -1) end, 6) as volume_ratio"""
_VOLA = f"""round(case when stddev_samp(abret) filter ({_OFF} between -10 and -1) > 0
  then stddev_samp(abret) filter ({_OFF} between -1 and 1)
       / stddev_samp(abret) filter ({_OFF} between -10 and -1) end, 6) as volatility_ratio"""


@query("car", with_views(_window_sql(_sum_in(-1, 1, "car_minus1_plus1"), -1, 1)))
def car(spark, d):
    return _round(es.car(v.filing(spark, d), _abnormal(spark, d)), "car_minus1_plus1")


@query("drift", with_views(_window_sql(_sum_in(2, 5, "drift_5d") + ", " + _sum_in(2, 10, "drift_10d"), 2, 10)))
def drift(spark, d):
    return _round(es.drift(v.filing(spark, d), _abnormal(spark, d), (5, 10)), "drift_5d", "drift_10d")


@query("volume_ratio", with_views(_window_sql(_VOLUME, -10, 0)))
def volume_ratio(spark, d):
    return _round(es.volume_ratio(v.filing(spark, d), _abnormal(spark, d), 10), "volume_ratio")


@query("volatility_ratio", with_views(_window_sql(_VOLA, -10, 1)))
def volatility_ratio(spark, d):
    return _round(es.volatility_ratio(v.filing(spark, d), _abnormal(spark, d), 10), "volatility_ratio")


@query("event_outcomes", with_views(_window_sql(", ".join([
    _sum_in(-1, 1, "car_minus1_plus1"), _sum_in(2, 5, "drift_5d"), _sum_in(2, 10, "drift_10d"), _VOLUME, _VOLA]),
    -10, 10)))
def event_outcomes(spark, d):
    out = es.event_outcomes(v.filing(spark, d), _abnormal(spark, d), (5, 10), 10)
    return _round(out, "car_minus1_plus1", "drift_5d", "drift_10d", "volume_ratio", "volatility_ratio")


@query("event_outcomes_full_windows", with_views(_window_sql(", ".join([
    _sum_in(-1, 1, "car_minus1_plus1"), _sum_in(2, 30, "drift_30d"), _sum_in(2, 60, "drift_60d"),
    _sum_in(2, 90, "drift_90d"), _VOLUME.replace("-10", "-30"), _VOLA.replace("-10", "-30")]), -30, 90)))
def event_outcomes_full_windows(spark, d):
    out = es.event_outcomes(v.filing(spark, d), _abnormal(spark, d))
    return _round(out, *[c for c in out.columns if c not in ("permno", "filing_date")])


_W = {"car_minus1_plus1": (-1, 1), "drift_30d": (2, 32), "drift_60d": (2, 62), "drift_90d": (2, 92)}


@query("window_return", with_views(_window_sql(", ".join(
    f"round(case when count(*) filter ({_OFF} between {a} and {b}) >= 2 "
    f"then product(1 + ret) filter ({_OFF} between {a} and {b}) - 1 end, 6) as {n}" for n, (a, b) in _W.items()),
    -1, 92)))
def window_return(spark, d):
    return _round(es.window_return(v.filing(spark, d), v.daily(spark, d)), *_W)


@query("momentum_calendar", with_views(_window_sql("""
  round(case when count(r.permno) >= 5 then product(1 + ret) - 1 end, 6) as past_ret,
  round(case when count(r.permno) >= 5 then stddev_samp(ret) end, 6) as past_vol""", -20, -5)))
def momentum_calendar(spark, d):
    return _round(es.momentum_calendar(v.filing(spark, d), v.daily(spark, d), -20, -5, 5), "past_ret", "past_vol")


_REVISION = """
  rev as (
    select ticker, filing_date,
           arg_max({m: mean_forecast, s: forecast_stdev, n: num_analysts}, (forecast_date, event_id))
             filter (forecast_date < filing_date) as b,
           arg_min({m: mean_forecast, s: forecast_stdev, n: num_analysts}, (forecast_date, event_id))
             filter (forecast_date > filing_date) as a
    from (select distinct ticker, filing_date from filing) join forecast using (ticker)
    where forecast_date - filing_date between -10 and 10 group by all)"""


@query("forecast_revision", with_views(f"""with {_REVISION}
  select ticker, filing_date, round(case when b.m <> 0 then (a.m - b.m) / abs(b.m) end, 6) as forecast_revision,
         round(a.s, 6) as forecast_dispersion, a.n as num_analysts
  from (select distinct ticker, filing_date from filing)
  left join (select * from rev where a is not null and b is not null) using (ticker, filing_date)"""))
def forecast_revision(spark, d):
    out = es.forecast_revision(v.filing(spark, d), v.forecast(spark, d), 10, ["event_id"])
    return _round(out, "forecast_revision", "forecast_dispersion")


@query("assemble_outcomes", with_views(f"""with {_REVISION}
  select f.accession_number, f.permno, f.ticker, f.filing_date, c.car_minus1_plus1,
         round(case when b.m <> 0 then (a.m - b.m) / abs(b.m) end, 6) as forecast_revision,
         round(a.s, 6) as forecast_dispersion, a.n as num_analysts
  from filing f left join ({_window_sql(_sum_in(-1, 1, "car_minus1_plus1"), -1, 1)}) c using (permno, filing_date)
  left join (select * from rev where a is not null and b is not null) r
    on r.ticker = f.ticker and r.filing_date = f.filing_date"""))
def assemble_outcomes(spark, d):
    f = v.filing(spark, d)
    out = es.assemble_outcomes(f, es.car(f, _abnormal(spark, d)),
                               es.forecast_revision(f, v.forecast(spark, d), 10, ["event_id"]))
    return _round(out, "car_minus1_plus1", "forecast_revision", "forecast_dispersion")


@query("asof_latest", with_views("""
  select f.accession_number, f.l_linenumber, f.gvkey, f.filing_date, c.datadate, round(c."at", 6) as "at", round(c.lt, 6) as lt
  from customer_filing f asof left join (
    select gvkey, datadate, arg_max("at", record_id) as "at", arg_max_null(lt, record_id) as lt
    from fundamental group by 1, 2) c
    on f.gvkey = c.gvkey and f.filing_date > c.datadate"""))
def asof_latest(spark, d):
    out = es.asof_latest(v.customer_filing(spark, d), v.fundamental(spark, d), ["at", "lt"], ["record_id"])
    return _round(out, "at", "lt")


@query("fundamental_ratios", with_views("""
  select record_id, round(ln(price * shares), 6) as size, round(ceq / (price * shares), 6) as bm,
         round(lt / "at", 6) as leverage from fundamental"""))
def fundamental_ratios(spark, d):
    out = ct.fundamental_ratios_v1(v.fundamental(spark, d)).select("record_id", "size", "bm", "leverage")
    return _round(out, "size", "bm", "leverage")


_EQUITY = """
  equity as (select *, coalesce(pstkrv, pstkl, pstk, 0) as ps,
                    coalesce(seq, 0) + coalesce(txditc, 0) - coalesce(pstkrv, pstkl, pstk, 0) as be,
                    coalesce(dlc, 0) + coalesce(dltt, 0) as total_debt from fundamental)"""


@query("book_equity", with_views(f"""with {_EQUITY}
  select record_id, round(ps, 4) as ps, round(be, 4) as be, round(total_debt, 4) as total_debt from equity"""))
def book_equity(spark, d):
    out = ct.book_equity(v.fundamental(spark, d)).select("record_id", "ps", "be", "total_debt")
    return _round(out, "ps", "be", "total_debt", digits=4)


@query("market_value_ratios", with_views(f"""with {_EQUITY}
  select record_id, round(ln(price * shares / 1000), 6) as size, round(be / (price * shares / 1000), 6) as bm,
         round(total_debt / "at", 6) as leverage from equity"""))
def market_value_ratios(spark, d):
    c = ct.book_equity(v.fundamental(spark, d)).withColumn("mktcap", F.col("price") * F.col("shares"))
    return _round(ct.fundamental_ratios_v2(c).select("record_id", "size", "bm", "leverage"), "size", "bm", "leverage")


@query("clean_monthly", with_views("""
  select permno, date, round(ret, 6) as ret, vol, abs(prc) as prc, shrout, round(abs(prc) * shrout, 4) as mktcap,
         cast(year(date) as int) as year, cast(month(date) as int) as month from monthly"""))
def clean_monthly(spark, d):
    return _round(_round(ct.clean_monthly(v.monthly(spark, d)), "ret"), "mktcap", digits=4)


def _vol_sql(src, n, m):
    return f"""select permno, year, month, arg_max(s, date) filter (s is not null) * sqrt(252) as past_vol from (
      select permno, date, cast(year(date) as int) as year, cast(month(date) as int) as month,
             case when count(ret) over w >= {m} then stddev_samp(ret) over w end as s from {src} where ret is not null
      window w as (partition by permno order by date rows between {n - 1} preceding and current row)) group by 1, 2, 3"""


@query("rolling_volatility", with_views(f"""
  select permno, year, month, round(past_vol, 6) as past_vol from ({_vol_sql('daily', 10, 5)})"""))
def rolling_volatility(spark, d):
    return _round(ct.rolling_volatility(v.daily(spark, d), 10, 5), "past_vol")


@query("rolling_volatility_60", with_views(f"""
  select permno, year, month, round(past_vol, 6) as past_vol from ({_vol_sql('monthly', 60, 20)})"""))
def rolling_volatility_60(spark, d):
    return _round(ct.rolling_volatility(v.monthly(spark, d)), "past_vol")


_MOMENTUM = """select permno, date, cast(year(date) as int) as year, cast(month(date) as int) as month,
    case when count(l) over w >= 6 then product(1 + l) over w - 1 end as past_ret
  from (select *, lag(ret) over (partition by permno order by date) as l from monthly)
  window w as (partition by permno order by date rows between 11 preceding and current row)"""


@query("momentum", with_views(f"select permno, date, round(past_ret, 6) as past_ret from ({_MOMENTUM})"))
def momentum(spark, d):
    return _round(ct.momentum(v.monthly(spark, d)).select("permno", "date", "past_ret"), "past_ret")


_LINKS = """
  links as (select c_custkey as gvkey, c_custkey % 50 as permno, date '1996-01-01' + cast(c_custkey % 900 as int) as start_date,
                   case when c_custkey % 3 = 0 then date '1999-06-30' + cast(c_custkey % 300 as int) end as end_date
            from customer)"""
_FUND = f"""{_LINKS}, {_EQUITY},
  fund as (select permno, cast(year(datadate) + 1 as int) as year,
             unnest(arg_min({{"at": "at", be: be, total_debt: total_debt}}, (e.gvkey, datadate, record_id)))
           from equity e join links l on e.gvkey = l.gvkey and datadate >= start_date
             and datadate <= coalesce(end_date, date '2099-12-31') group by 1, 2)"""


def _fund(spark, d):
    k = F.col("c_custkey")
    links = v.table(spark, d, "customer").select(
        k.alias("gvkey"), (k % 50).alias("permno"),
        F.date_add(F.lit("1996-01-01").cast("date"), (k % 900).cast("int")).alias("start_date"),
        F.when(k % 3 == 0, F.date_add(F.lit("1999-06-30").cast("date"), (k % 300).cast("int"))).alias("end_date"))
    return ct.link_fundamentals(ct.book_equity(v.fundamental(spark, d)), links, ["at", "be", "total_debt"], ["record_id"])


@query("link_fundamentals", with_views(f"""with {_FUND}
  select permno, year, round("at", 4) as "at", round(be, 4) as be, round(total_debt, 4) as total_debt from fund"""))
def link_fundamentals(spark, d):
    return _round(_fund(spark, d), "at", "be", "total_debt", digits=4)


_CONTROLS = f"""{_FUND},
  controls as (
    select accession_number, l_linenumber, permno, filing_date, year, ln(mktcap / 1000) as size, be / (mktcap / 1000) as bm,
           total_debt / "at" as leverage, past_ret, past_vol
    from (select l_orderkey as accession_number, l_linenumber, l_suppkey as permno, cast(l_shipdate as date) as filing_date,
                 cast(year(l_shipdate) as int) as year, cast(month(l_shipdate) as int) as month from lineitem)
    left join (select permno, cast(year(date) as int) as year, cast(month(date) as int) as month,
                      abs(prc) * shrout as mktcap from monthly) using (permno, year, month)
    left join (select * exclude (date) from ({_MOMENTUM})) using (permno, year, month)
    left join ({_vol_sql('monthly', 12, 4)}) using (permno, year, month)
    left join fund using (permno, year))"""
_C = ["size", "bm", "leverage", "past_ret", "past_vol"]


def _controls(spark, d):
    # The line number travels inside the key, so all order lines stay apart.
    f = v.table(spark, d, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("accession_number"),
        F.col("l_suppkey").alias("permno"), F.to_date("l_shipdate").alias("filing_date"))
    m = ct.clean_monthly(v.monthly(spark, d))
    out = ct.assemble_controls(f, m, ct.momentum(m), ct.rolling_volatility(v.monthly(spark, d), 12, 4), _fund(spark, d))
    return out.select(F.col("accession_number.l_orderkey").alias("accession_number"),
                      F.col("accession_number.l_linenumber").alias("l_linenumber"),
                      *[c for c in out.columns if c != "accession_number"])


@query("assemble_controls", with_views(f"""with {_CONTROLS}
  select accession_number, l_linenumber, permno, filing_date, year, {', '.join(f'round({c}, 5) as {c}' for c in _C)}
  from controls"""))
def assemble_controls(spark, d):
    return _round(_controls(spark, d), *_C, digits=5)


@query("winsorize", with_views(f"""with {_CONTROLS},
  b as (select {', '.join(f'quantile_cont({c}, 1e-2) as lo_{c}, quantile_cont({c}, 99e-2) as hi_{c}' for c in _C[1:])}
        from controls)
  select accession_number, l_linenumber, permno, filing_date, year, round(size, 5) as size,
         {', '.join(f'round(case when {c} is not null then greatest(least({c}, hi_{c}), lo_{c}) end, 5) as {c}' for c in _C[1:])}
  from controls, b"""))
def winsorize(spark, d):
    return _round(ct.winsorize(_controls(spark, d), materialize=True), *_C, digits=5)


@query("control_coverage", with_views(f"with {_CONTROLS}" + " union all ".join(
    f"""select '{c}' as "column", count({c}) as n_present, count(*) as n_rows,
        round(count({c}) * 1e2 / count(*), 6) as pct from controls""" for c in _C)))
def control_coverage(spark, d):
    return _round(ct.coverage(_controls(spark, d), _C), "pct")


@query("panel_range", with_views("""
  select count(*) as n_rows, count(distinct permno) as n_firms, min(filing_date) as first_date,
         max(filing_date) as last_date from filing"""))
def panel_range(spark, d):
    return ct.panel_range(v.filing(spark, d))


@query("firm_months", """
  select distinct l_suppkey as permno, cast(year(l_shipdate) as int) as year, cast(month(l_shipdate) as int) as month
  from lineitem where l_suppkey is not null""")
def firm_months(spark, d):
    return es.firm_months(v.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("permno"), F.to_date("l_shipdate").alias("filing_date")))


@query("canonical_dates", """
  select o_orderkey as accession_number, try_cast(t as date) as filing_date, cast(year(try_cast(t as date)) as int) as year
  from (select o_orderkey, case when o_orderkey % 10 = 3 then 'unknown' else strftime(o_orderdate, '%Y-%m-%d') end as t
        from orders)""")
def canonical_dates(spark, d):
    text = F.when(F.col("o_orderkey") % 10 == 3, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return es.canonical_dates(v.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("accession_number"), text.alias("filed_date")))
