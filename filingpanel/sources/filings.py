"""Filing texts: folders of text files or zip archives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import strip
from . import archive


def cik_of_accession(accession: Column) -> Column:
    """Integer before the first hyphen; null without a hyphen or when not a number."""
    head = F.element_at(F.split(F.trim(accession), "-"), 1)
    return F.when(
        F.trim(accession).contains("-") & head.rlike(r"^\s*[+-]?\d+\s*$"), head.try_cast("long")
    )


def with_path_keys(df: DataFrame, path: str = "path") -> DataFrame:
    """Add accession_number (base name without ``.txt``) and year (first ``/dddd/``)."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    year = F.regexp_extract(path, r"/(\d{4})/", 1)
    return df.withColumn("accession_number", F.replace(base, F.lit(".txt"), F.lit(""))).withColumn(
        "year", F.when(year != "", year.cast("int"))
    )


def limit_files(df: DataFrame, n: int, recent_years: list[int] | None = None, path: str = "path") -> DataFrame:
    """The first ``n`` paths; with ``recent_years`` only such paths, if there are any."""
    if recent_years:
        years = "|".join(str(y) for y in recent_years)
        recent = F.col(path).rlike(f"/({years})/")
        found = df.agg(F.coalesce(F.bool_or(recent), F.lit(False)).alias("found")).scalar()
        df = df.where(recent | ~found)
    return df.orderBy(path).limit(n)


def _as_documents(raw: DataFrame, item_type: str) -> DataFrame:
    return (
        with_path_keys(raw.withColumn("text", strip(F.col("text"))).where(F.col("text") != ""))
        .withColumn("cik", cik_of_accession(F.col("accession_number")))
        .select(
            "accession_number", "cik", "year", "text", F.lit(item_type).alias("item_type"),
            F.length("text").cast("int").alias("text_length"),
        )
    )


def read_filings(spark: SparkSession, path: str, item_type: str) -> DataFrame:
    """Documents from a folder tree of ``.txt`` files; bytes that are not UTF-8 are ignored."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(
                {"path": pdf["path"], "text": [bytes(b).decode("utf-8", "ignore") for b in pdf["content"]]}
            )

    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt")
        .load(path).select("path", "content")
    )
    return _as_documents(files.mapInPandas(decode, "path string, text string"), item_type)


def read_filing_archives(spark: SparkSession, path: str, item_type: str, member_bytes: int = archive.MEMBER_BYTES) -> DataFrame:
    """Documents from zip archives, of one file or all in a folder; bytes that are not UTF-8 are ignored.

    The members of an archive are dealt to tasks by about ``member_bytes`` of packed text; those that cannot be read
    (``archive.read_members`` tells why) and empty ones are left out.
    """
    members = archive.read_members(spark, path, ".txt", member_bytes, text=True).where("error IS NULL")
    return _as_documents(members.select(F.concat(F.lit("/"), F.col("path")).alias("path"), "text"), item_type)
