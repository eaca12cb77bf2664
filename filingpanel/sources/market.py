"""Extracts from market and accounting tables: projections and filters that reach the scan."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Parquet scan of the given columns only."""
    return spark.read.parquet(path).select(*columns)


def extract_returns(
    returns: DataFrame, keys: DataFrame, lo: datetime.date | str, hi: datetime.date | str,
    market: DataFrame | None = None,
) -> DataFrame:
    """Rows of the wanted permnos within [lo, hi]; optional index return by date.

    The key set is a semi join (no id lists in the query text); the date range
    is a plain predicate, so it is pushed to Parquet or JDBC.
    """
    out = returns.where(F.col("date").between(F.lit(lo), F.lit(hi)) & F.col("ret").isNotNull())
    out = out.join(keys.select("permno").distinct(), "permno", "left_semi")
    if market is not None:
        out = out.join(market, "date", "left")
    return out


def filter_common_shares(df: DataFrame) -> DataFrame:
    return df.where(F.col("shrcd").isin(10, 11))


def filter_links(df: DataFrame) -> DataFrame:
    return df.where(F.col("linktype").isin("LU", "LC") & F.col("linkprim").isin("P", "C"))


def filter_eps_annual(df: DataFrame) -> DataFrame:
    return df.where((F.col("fpi") == "1") & (F.col("measure") == "EPS"))


def filter_std_annual(df: DataFrame) -> DataFrame:
    return df.where(
        (F.col("indfmt") == "INDL") & (F.col("datafmt") == "STD") & (F.col("popsrc") == "D")
        & (F.col("consol") == "C")
    )
