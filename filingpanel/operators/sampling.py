"""Samplers, splits and sample reports.

A seeded hash of the row key replaces the random stream: the sample depends on
the seed and the keys only, not on partitions, executors or retries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.sampling import cap_per_group, hash_position, hash_rank, lowest_ranked

SENTENCE_KEY = ["accession_number", "item_type", "sentence_id"]


def sample_n(df: DataFrame, n: int, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """``n`` rows without replacement (all rows if there are fewer)."""
    return lowest_ranked(df, n, hash_rank(seed, *(key or SENTENCE_KEY)))


def cap_per_stratum(
    df: DataFrame, keys: list[str], n: int, seed: int = 42, null_cap: int | None = None,
    key: list[str] | None = None, salt_digits: int = 1,
) -> DataFrame:
    """At most ``n`` random rows per stratum; rows with a null first key may have their own cap."""
    return cap_per_group(df, keys, n, hash_rank(seed, *(key or SENTENCE_KEY)), null_cap, salt_digits)


def stratified_sample(
    df: DataFrame, per_filing: int = 300, per_firm: int = 5000, per_cell: int = 20000, seed: int = 42,
    null_firm: int = 100,
) -> DataFrame:
    """Three caps in turn: (cik, year, item), cik, and (year, item) without null years or items.

    After the first cap a firm holds at most ``per_filing`` rows per year and
    item, so the second needs no salt.
    """
    first = cap_per_stratum(df, ["cik", "year", "item_type"], per_filing, seed)
    second = cap_per_stratum(first, ["cik"], per_firm, seed, null_cap=null_firm, salt_digits=0)
    third = second.where(F.col("year").isNotNull() & F.col("item_type").isNotNull())
    return cap_per_stratum(third, ["year", "item_type"], per_cell, seed)


def firm_balanced_sample(
    df: DataFrame, per_firm: int = 1000, per_cell: int = 50000, total: int = 5_000_000, seed: int = 42,
    null_firm: int = 100,
) -> DataFrame:
    """Older sampler: cap per firm, cap per (year, item), then a global sample."""
    first = cap_per_stratum(df, ["cik"], per_firm, seed, null_cap=null_firm)
    cells = first.where(F.col("year").isNotNull() & F.col("item_type").isNotNull())
    return sample_n(cap_per_stratum(cells, ["year", "item_type"], per_cell, seed), total, seed)


def bootstrap_filings(df: DataFrame, frac: float = 0.8, replica: int = 0, seed: int = 42) -> DataFrame:
    """Sentences of ``int(frac * filings)`` filings drawn without replacement; seed + replica."""
    filings = df.select("accession_number").distinct()
    chosen = lowest_ranked(
        filings, F.floor(F.col("_total") * F.lit(frac)), hash_rank(seed + replica, "accession_number")
    )
    return df.join(chosen, "accession_number", "left_semi")


def firm_folds(df: DataFrame, k: int = 5, seed: int = 42, firm: str = "cik") -> DataFrame:
    """Fold number per row; all rows of a firm share a fold (position in hash order modulo k)."""
    firms = df.select(firm).where(F.col(firm).isNotNull()).distinct()
    numbered = hash_position(firms, hash_rank(seed, firm), "_p").select(
        firm, (F.col("_p") % k).cast("int").alias("fold")
    )
    return df.join(numbered, firm, "left")


def kfold(df: DataFrame, k: int, key: list[str], seed: int = 42) -> DataFrame:
    """Row folds from the key hash; no shuffle."""
    h = F.conv(F.substring(hash_rank(seed, *key), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", (h % k).cast("int"))


def panel_folds(df: DataFrame, k: int, key: list[str], seed: int = 42, firm: str = "cik") -> DataFrame:
    """Firm folds where the firm is known; rows without firm id, or all rows of a panel without that column, by their key."""
    rows = kfold(df, k, key, seed)
    if firm not in df.columns:
        return rows
    return firm_folds(rows.withColumnRenamed("fold", "_row_fold"), k, seed, firm).withColumn(
        "fold", F.coalesce("fold", "_row_fold")).select(*[c for c in df.columns if c != "fold"], "fold")


def temporal_split(df: DataFrame, year: int, min_rows: int = 100) -> DataFrame:
    """Column ``split``: train before ``year``, test from it on; all rows train if a side is too small."""
    early, late = F.col("year") < year, F.col("year") >= year
    enough = df.agg(
        ((F.count_if(early) >= min_rows) & (F.count_if(late) >= min_rows)).alias("ok")
    ).scalar()
    return df.withColumn("split", F.when(~enough | early, "train").when(late, "test"))


def firm_count_summary(sample: DataFrame, cap: int, firm: str = "cik") -> DataFrame:
    """Distribution of rows per firm and counts by size band."""
    counts = sample.where(F.col(firm).isNotNull()).groupBy(firm).agg(F.count("*").alias("n"))
    n = F.col("n")
    stats = counts.agg(
        F.count("*").alias("n_firms"), F.sum("n").alias("n_rows"), F.avg("n").alias("mean"), F.min("n").alias("min"),
        F.max("n").alias("max"), F.stddev_samp("n").alias("std"), F.count_if(n == cap).alias("at_cap"),
        F.count_if(n < 100).alias("below_100"), F.count_if((n >= 100) & (n < 1000)).alias("from_100"),
        F.count_if((n >= 1000) & (n < cap)).alias("from_1000"),
    )
    return stats.withColumn("median", exact_quantiles(counts, "n", {"median": 0.5}).scalar())


def sampling_rate(sample: DataFrame, full: DataFrame) -> DataFrame:
    """Rows of the sample and of the source, with the rate in percent."""
    both = sample.select(F.lit(1).alias("s")).unionAll(full.select(F.lit(0).alias("s")))
    return both.agg(F.count_if(F.col("s") == 1).alias("n_sample"), F.count_if(F.col("s") == 0).alias("n_full")).withColumn(
        "rate_pct", F.when(F.col("n_full") > 0, F.col("n_sample") / F.col("n_full") * 100)
    )


def year_item_counts(sample: DataFrame, items: list[str]) -> DataFrame:
    """Rows per year with one column per item, zero where empty."""
    return sample.groupBy("year").pivot("item_type", items).count().fillna(0, subset=items)


def reduction_report(before: DataFrame, after: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Groups, groups over the cap, rows before and after, share removed."""
    groups = before.groupBy(*keys).agg(F.count("*").alias("n")).agg(
        F.count("*").alias("n_groups"), F.count_if(F.col("n") > cap).alias("n_capped"), F.sum("n").alias("n_before")
    )
    return groups.withColumn("n_after", after.agg(F.count("*")).scalar()).withColumn(
        "removed_pct", (1 - F.col("n_after") / F.col("n_before")) * 100
    )


def top_groups(df: DataFrame, key: str, n: int = 10, smallest: bool = False) -> DataFrame:
    """The ``n`` largest (or smallest) groups by row count, ties by key."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_rows"))
    return counts.orderBy(F.asc("n_rows") if smallest else F.desc("n_rows"), key).limit(n)
