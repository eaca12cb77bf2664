"""Filing metadata: CSV table and nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas


def read_metadata(spark: SparkSession, path: str, schema: str = schemas.METADATA) -> DataFrame:
    """CSV metadata with identifiers as long or string, never as double."""
    return spark.read.csv(path, header=True, schema=schema)


def metadata_summary(df: DataFrame) -> DataFrame:
    """Year range, number of rows, firms and tickers."""
    return df.agg(
        F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"),
        F.count("*").alias("n_rows"), F.countDistinct("cik").alias("n_firms"),
        F.countDistinct("ticker").alias("n_tickers"),
    )


def flatten_ticker_map(df: DataFrame, col: str = "json") -> DataFrame:
    """``{"0": {cik_str, ticker, title}, ...}`` to one row per entry."""
    entries = df.select(F.explode(F.from_json(col, schemas.TICKER_MAP)).alias("entry", "company"))
    return entries.select(
        F.col("company.cik_str").alias("cik"), "company.ticker", F.col("company.title").alias("company_name")
    )


def flatten_recent_filings(df: DataFrame, col: str = "json", cik: str = "cik") -> DataFrame:
    """Parallel arrays accessionNumber / filingDate / form to one row per filing."""
    f = F.from_json(col, schemas.RECENT_FILINGS)
    return (
        df.select(cik, f.alias("f"))
        .select(cik, F.inline(F.arrays_zip("f.accessionNumber", "f.filingDate", "f.form")))
        .select(
            cik, F.col("accessionNumber").alias("accession_number"), F.col("filingDate").alias("filing_date"), "form"
        )
    )
