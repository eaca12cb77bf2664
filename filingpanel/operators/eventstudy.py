"""Event study: point-in-time links, event windows, as-of joins.

Events are first reduced to distinct (key, date) pairs, so a busy firm is
bounded by the calendar.  Windows use a bucketed range join: an event meets only
the date buckets its window touches, on the equi-key (firm, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .prepare import first_per_key

_BUCKET = 32  # days
_OFF = "_off"  # days from the filing date to the observation


def _distinct_events(f: DataFrame, key: str) -> DataFrame:
    return f.select(key, "filing_date").where(
        F.col(key).isNotNull() & F.col("filing_date").isNotNull()
    ).distinct()


def _windowed(f: DataFrame, series: DataFrame, key: str, date: str, lo: int, hi: int) -> DataFrame:
    """Pairs of event and observation with ``lo <= date - filing_date <= hi``."""
    day = F.unix_date("filing_date")
    events = _distinct_events(f, key).withColumn(
        "_b", F.explode(F.sequence(F.floor((day + lo) / _BUCKET), F.floor((day + hi) / _BUCKET)))
    )
    obs = series.withColumn("_b", F.floor(F.unix_date(date) / _BUCKET))
    return (
        events.join(obs, [key, "_b"])
        .withColumn(_OFF, F.datediff(F.col(date), F.col("filing_date")))
        .where(F.col(_OFF).between(lo, hi))
    )


def _per_event(f: DataFrame, pairs: DataFrame, key: str, aggs: list[Column]) -> DataFrame:
    """Aggregates per distinct event; events without observations get nulls."""
    return _distinct_events(f, key).join(pairs.groupBy(key, "filing_date").agg(*aggs), [key, "filing_date"], "left")


def _in(lo: int, hi: int) -> Column:
    return F.col(_OFF).between(lo, hi)


def _sum_in(col: str, lo: int, hi: int) -> Column:
    """Sum over the window; null without observations, missing values count as zero."""
    return F.when(F.count_if(_in(lo, hi)) > 0, F.coalesce(F.sum(F.when(_in(lo, hi), F.col(col))), F.lit(0.0)))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def abnormal_returns(ret: DataFrame, market: DataFrame) -> DataFrame:
    """Return minus market return of the day; values that are not numbers become null."""
    def number(c: str) -> Column:
        x = F.col(c).try_cast("double")
        return F.when(~F.isnan(x), x)

    return (
        ret.withColumn("ret", number("ret")).join(market.withColumn("mkt_ret", number("mkt_ret")), "date", "left")
        .withColumn("abret", F.col("ret") - F.col("mkt_ret"))
    )


def car_column(lo: int = -1, hi: int = 1) -> Column:
    return _sum_in("abret", lo, hi).alias("car_minus1_plus1" if (lo, hi) == (-1, 1) else f"car_{lo}_{hi}")


def car(f: DataFrame, r: DataFrame, lo: int = -1, hi: int = 1) -> DataFrame:
    """Sum of abnormal returns over calendar days [lo, hi]."""
    return _per_event(f, _windowed(f, r, "permno", "date", lo, hi), "permno", [car_column(lo, hi)])


def drift(f: DataFrame, r: DataFrame, days: Sequence[int] = (30, 60, 90)) -> DataFrame:
    """Sum of abnormal returns over [+2, +d] for each d."""
    pairs = _windowed(f, r, "permno", "date", 2, max(days))
    return _per_event(f, pairs, "permno", [_sum_in("abret", 2, d).alias(f"drift_{d}d") for d in days])


def _volume(lookback: int) -> Column:
    return _ratio(F.max(F.when(F.col(_OFF) == 0, F.col("vol"))), F.avg(F.when(_in(-lookback, -1), F.col("vol"))))


def volume_ratio(f: DataFrame, r: DataFrame, lookback: int = 30) -> DataFrame:
    """Volume of the filing day over the mean volume of the days before."""
    pairs = _windowed(f, r, "permno", "date", -lookback, 0)
    return _per_event(f, pairs, "permno", [_volume(lookback).alias("volume_ratio")])


def _volatility(lookback: int) -> Column:
    return _ratio(
        F.stddev_samp(F.when(_in(-1, 1), F.col("abret"))), F.stddev_samp(F.when(_in(-lookback, -1), F.col("abret")))
    )


def volatility_ratio(f: DataFrame, r: DataFrame, lookback: int = 30) -> DataFrame:
    """Sample std of abnormal returns in [-1, 1] over that of the days before."""
    pairs = _windowed(f, r, "permno", "date", -lookback, 1)
    return _per_event(f, pairs, "permno", [_volatility(lookback).alias("volatility_ratio")])


def event_outcomes(
    f: DataFrame, r: DataFrame, days: Sequence[int] = (30, 60, 90), lookback: int = 30
) -> DataFrame:
    """Announcement return, drifts, volume and volatility ratio from one pass over the pairs."""
    pairs = _windowed(f, r, "permno", "date", -lookback, max(days))
    return _per_event(f, pairs, "permno", [
        car_column(), *[_sum_in("abret", 2, d).alias(f"drift_{d}d") for d in days],
        _volume(lookback).alias("volume_ratio"), _volatility(lookback).alias("volatility_ratio"),
    ])


RAW_WINDOWS = {"car_minus1_plus1": (-1, 1), "drift_30d": (2, 32), "drift_60d": (2, 62), "drift_90d": (2, 92)}


def window_return(
    f: DataFrame, r: DataFrame, windows: dict[str, tuple[int, int]] | None = None, min_obs: int = 2
) -> DataFrame:
    """Compounded raw return per window; null with fewer than ``min_obs`` days."""
    windows = windows or RAW_WINDOWS
    lo, hi = min(w[0] for w in windows.values()), max(w[1] for w in windows.values())
    aggs = [
        F.when(F.count_if(_in(*w)) >= min_obs, F.product(F.when(_in(*w), 1 + F.col("ret"))) - 1).alias(n)
        for n, w in windows.items()
    ]
    return _per_event(f, _windowed(f, r, "permno", "date", lo, hi), "permno", aggs)


def momentum_calendar(
    f: DataFrame, r: DataFrame, lo: int = -180, hi: int = -30, min_obs: int = 60
) -> DataFrame:
    """Compounded return and its volatility over calendar days [lo, hi]; null below ``min_obs`` days."""
    enough = F.count("*") >= min_obs
    return _per_event(f, _windowed(f, r, "permno", "date", lo, hi), "permno", [
        F.when(enough, F.product(1 + F.col("ret")) - 1).alias("past_ret"),
        F.when(enough, F.stddev_samp("ret")).alias("past_vol"),
    ])


def forecast_revision(f: DataFrame, fc: DataFrame, days: int = 30, tie: Sequence[str] = ()) -> DataFrame:
    """Change of the consensus from the last forecast before to the first after the filing.

    Relative to the absolute earlier mean, null if that is zero; dispersion and
    number of analysts are those of the later forecast.
    """
    known = f.where(F.col("ticker") != "UNKNOWN")
    pairs = _windowed(known, fc, "ticker", "forecast_date", -days, days)
    row = F.struct("mean_forecast", "forecast_stdev", "num_analysts")
    at = F.struct("forecast_date", *tie)
    both = pairs.groupBy("ticker", "filing_date").agg(
        F.max_by(row, F.when(F.col(_OFF) < 0, at)).alias("b"), F.min_by(row, F.when(F.col(_OFF) > 0, at)).alias("a")
    ).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    before = F.col("b.mean_forecast")
    out = both.select(
        "ticker", "filing_date",
        F.when(before != 0, (F.col("a.mean_forecast") - before) / F.abs(before)).alias("forecast_revision"),
        F.col("a.forecast_stdev").alias("forecast_dispersion"), F.col("a.num_analysts").alias("num_analysts"),
    )
    return _distinct_events(known, "ticker").join(out, ["ticker", "filing_date"], "left")


def assemble_outcomes(f: DataFrame, returns: DataFrame, forecasts: DataFrame | None = None) -> DataFrame:
    """Filings with their outcomes; of several rows per key on a right side the lowest in column order counts."""
    for right, key in ((returns, ["permno", "filing_date"]), (forecasts, ["ticker", "filing_date"])):
        if right is not None:
            rest = [c for c in right.columns if c not in key]
            f = f.join(first_per_key(right.select(*key, *rest), key, rest), key, "left")
    return f


def _interval_match(f: DataFrame, links: DataFrame, key: str, value: str, start: str, end: Column) -> DataFrame:
    """First link by start per distinct (key, date) whose interval holds the date."""
    hits = _distinct_events(f, key).join(links.select(key, value, start, end.alias("_end")), key).where(
        (F.col(start) <= F.col("filing_date")) & (F.col("filing_date") <= F.col("_end"))
    )
    return hits.groupBy(key, "filing_date").agg(F.min_by(value, F.struct(start, value)).alias(value))


def link_asof_interval(f: DataFrame, links: DataFrame) -> DataFrame:
    """permno valid at the filing date by ticker; unmatched and unknown tickers drop out."""
    known = f.where(F.col("ticker") != "UNKNOWN").drop("permno")
    hit = _interval_match(known, links, "ticker", "permno", "start_date", F.col("end_date"))
    return known.join(hit, ["ticker", "filing_date"])


def link_equi(f: DataFrame, links: DataFrame) -> DataFrame:
    """All permnos of a cik; filings without one drop out."""
    return f.drop("permno").join(links.select("cik", "permno").distinct(), "cik").where(F.col("permno").isNotNull())


def link_open_interval(f: DataFrame, links: DataFrame) -> DataFrame:
    """gvkey valid at the filing date by permno; an open end means still valid; null if none."""
    end = F.coalesce(F.col("end_date"), F.to_date(F.lit("2099-12-31")))
    hit = _interval_match(f, links, "permno", "gvkey", "start_date", end)
    return f.drop("gvkey").join(hit, ["permno", "filing_date"], "left")


def asof_latest(f: DataFrame, c: DataFrame, cols: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Columns of the latest record strictly before the filing date, per gvkey.

    Both sides are reduced to one row per (gvkey, day) and merged in one sorted
    window; no pair of filing and record is ever built.
    """
    order = F.struct(*tie) if tie else F.struct(*cols)
    records = c.groupBy("gvkey", F.col("datadate").alias("_d")).agg(
        F.max_by(F.struct("datadate", *cols), order).alias("_rec")
    ).withColumn("_kind", F.lit(1))
    events = _distinct_events(f, "gvkey").select("gvkey", F.col("filing_date").alias("_d"), F.lit(0).alias("_kind"))
    w = Window.partitionBy("gvkey").orderBy("_d", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = (
        events.unionByName(records, allowMissingColumns=True)
        .withColumn("_last", F.last("_rec", ignorenulls=True).over(w)).where(F.col("_kind") == 0)
        .select("gvkey", F.col("_d").alias("filing_date"), "_last.datadate", *[F.col(f"_last.{x}") for x in cols])
    )
    return f.join(filled, ["gvkey", "filing_date"], "left")


DATE_ALIASES = ("filing_date", "file_date", "filed_date", "date")


def canonical_dates(df: DataFrame) -> DataFrame:
    """Rename the first known date column to filing_date, parse it, derive the year."""
    found = [c for c in DATE_ALIASES if c in df.columns]
    if not found:
        raise ValueError(f"no date column among {DATE_ALIASES}")
    out = df if found[0] == "filing_date" else df.withColumnRenamed(found[0], "filing_date")
    return out.withColumn("filing_date", F.col("filing_date").try_cast("date")).withColumn(
        "year", F.year("filing_date")
    )


def firm_months(f: DataFrame) -> DataFrame:
    """Distinct (permno, year, month) of filings with a permno."""
    return f.where(F.col("permno").isNotNull()).select(
        "permno", F.year("filing_date").alias("year"), F.month("filing_date").alias("month")
    ).distinct()
