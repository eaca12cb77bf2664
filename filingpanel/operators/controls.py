"""Firm controls: accounting ratios, rolling measures, assembly, winsorising, coverage."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.durable import durable
from ..functions.quantiles import exact_quantiles
from .docpanel import CONTROLS

WINSORIZED = ("bm", "leverage", "past_ret", "past_vol")


def _log(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def _div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def fundamental_ratios_v1(c: DataFrame) -> DataFrame:
    """Size, book-to-market and leverage from price and shares."""
    cap = F.col("price") * F.col("shares")
    return c.withColumn("size", _log(cap)).withColumn("bm", _div(F.col("ceq"), cap)).withColumn(
        "leverage", _div(F.col("lt"), F.col("at"))
    )


def fundamental_ratios_v2(c: DataFrame) -> DataFrame:
    """Size, book-to-market and leverage from market value in thousands and book equity."""
    cap = F.col("mktcap") / 1000
    return c.withColumn("size", _log(cap)).withColumn("bm", _div(F.col("be"), cap)).withColumn(
        "leverage", _div(F.col("total_debt"), F.col("at"))
    )


def book_equity(c: DataFrame) -> DataFrame:
    """Preferred stock, book equity and total debt, missing parts as zero."""
    def known(*cols: str) -> Column:
        return F.coalesce(*[F.col(x) for x in cols], F.lit(0.0))

    return (
        c.withColumn("ps", known("pstkrv", "pstkl", "pstk"))
        .withColumn("be", known("seq") + known("txditc") - F.col("ps"))
        .withColumn("total_debt", known("dlc") + known("dltt"))
    )


def clean_monthly(m: DataFrame) -> DataFrame:
    """Absolute price (negative marks a quote average), market value, year and month."""
    return (
        m.withColumn("prc", F.abs("prc")).withColumn("mktcap", F.col("prc") * F.col("shrout"))
        .withColumn("year", F.year("date")).withColumn("month", F.month("date"))
    )


def rolling_volatility(d: DataFrame, n: int = 60, min_obs: int = 20) -> DataFrame:
    """Annualised std of the last ``n`` returns; last known value of each calendar month.

    One row per (permno, date) is expected, so a window holds one firm's trading days.
    """
    w = Window.partitionBy("permno").orderBy("date").rowsBetween(-(n - 1), 0)
    vol = F.when(F.count("ret").over(w) >= min_obs, F.stddev_samp("ret").over(w))
    return (
        d.where(F.col("ret").isNotNull()).withColumn("_vol", vol)
        .groupBy("permno", F.year("date").alias("year"), F.month("date").alias("month"))
        .agg((F.max_by("_vol", F.when(F.col("_vol").isNotNull(), F.col("date"))) * math.sqrt(252)).alias("past_vol"))
    )


def momentum(m: DataFrame, n: int = 12, min_obs: int = 6) -> DataFrame:
    """Compounded return of the ``n`` rows before the current one; null below ``min_obs`` values."""
    order = Window.partitionBy("permno").orderBy("date")
    w = order.rowsBetween(-(n - 1), 0)
    lagged = m.withColumn("_lag", F.lag("ret").over(order))
    return lagged.withColumn(
        "past_ret", F.when(F.count("_lag").over(w) >= min_obs, F.product(1 + F.col("_lag")).over(w) - 1)
    ).drop("_lag")


def link_fundamentals(c: DataFrame, ccm: DataFrame, cols: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Accounting data per (permno, year): records valid under the link, used in the next year."""
    end = F.coalesce(F.col("end_date"), F.to_date(F.lit("2099-12-31")))
    linked = c.join(ccm.select("gvkey", "permno", "start_date", end.alias("_end")), "gvkey").where(
        F.col("datadate").between(F.col("start_date"), F.col("_end"))
    ).withColumn("year", F.year("datadate") + 1)
    order = F.struct("gvkey", "datadate", *tie)
    first = linked.groupBy("permno", "year").agg(F.min_by(F.struct(*cols), order).alias("_r"))
    return first.select("permno", "year", *[F.col("_r")[x].alias(x) for x in cols])


def assemble_controls(
    f: DataFrame, monthly: DataFrame, mom: DataFrame, vol: DataFrame, fundamentals: DataFrame
) -> DataFrame:
    """Filings with market value, momentum, volatility (by month) and accounting data (by year)."""
    month = ["permno", "year", "month"]
    base = f.select(
        "accession_number", "permno", "filing_date", F.year("filing_date").alias("year"),
        F.month("filing_date").alias("month"),
    )
    joined = (
        base.join(monthly.select(*month, "mktcap"), month, "left").join(mom.select(*month, "past_ret"), month, "left")
        .join(vol.select(*month, "past_vol"), month, "left")
        .join(fundamentals.select("permno", "year", "at", "be", "total_debt"), ["permno", "year"], "left")
    )
    return fundamental_ratios_v2(joined).select("accession_number", "permno", "filing_date", "year", *CONTROLS)


def winsorize(
    df: DataFrame, cols: Sequence[str] = WINSORIZED, low: float = 0.01, high: float = 0.99, materialize: bool = False
) -> DataFrame:
    """Clip to the global quantiles; two numbers per column are fitted first.

    The table is read three times; ``materialize`` writes it to the checkpoint
    folder first, for inputs that are costly to compute.
    """
    df = durable(df) if materialize else df
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in cols])
    long = df.select(F.inline(pairs))
    bounds = {r["name"]: r for r in exact_quantiles(long, "x", {"lo": low, "hi": high}, ["name"], few_groups=True).collect()}
    for c in cols:
        if c in bounds:
            x = F.greatest(F.least(F.col(c), F.lit(bounds[c]["hi"])), F.lit(bounds[c]["lo"]))
            df = df.withColumn(c, F.when(F.col(c).isNotNull(), x))
    return df


def coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-null count and share per column."""
    one = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in cols])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("n_present"), F.col("_n").alias("n_rows")) for c in cols
    ])
    return one.select(F.inline(rows)).withColumn(
        "pct", F.when(F.col("n_rows") > 0, F.col("n_present") / F.col("n_rows") * 100)
    )


def panel_range(df: DataFrame) -> DataFrame:
    """Rows, firms and date range."""
    return df.agg(
        F.count("*").alias("n_rows"), F.countDistinct("permno").alias("n_firms"),
        F.min("filing_date").alias("first_date"), F.max("filing_date").alias("last_date"),
    )
