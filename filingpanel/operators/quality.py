"""Data quality: reports, checks as rows, coverage and key comparisons."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions.quantiles import exact_quantiles
from .controls import coverage
from .prepare import first_per_key

CHECK = "phase string, check string, passed boolean, severity string, detail string"


def quality_report(docs: DataFrame) -> DataFrame:
    """One row: records, filings, years, sparse and peak years, short texts, CIK success."""
    per_year = docs.where(F.col("year").isNotNull()).groupBy("year").agg(F.count("accession_number").alias("n"))
    years = per_year.agg(
        F.count_if(F.col("n") < 100).alias("sparse_years"),
        F.max_by("year", F.struct(F.col("n"), -F.col("year"))).alias("peak_year"), F.max("n").alias("peak_filings"),
    )
    base = docs.agg(
        F.count("*").alias("n_records"), F.countDistinct("accession_number").alias("n_filings"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.count_if(F.col("text_length") < 100).alias("n_short"), F.count("cik").alias("n_cik"),
        F.countDistinct("cik").alias("n_firms"),
    )
    return base.withColumn("_y", years.select(F.struct("*")).scalar()).select(*base.columns, "_y.*").withColumn(
        "short_pct", F.col("n_short") / F.col("n_records") * 100
    ).withColumn("cik_pct", F.col("n_cik") / F.col("n_records") * 100).withColumn(
        "cik_warning", F.col("n_cik") < 0.9 * F.col("n_records"))


def length_by_item(docs: DataFrame) -> DataFrame:
    """Count, mean, median, minimum and maximum text length per item."""
    stats = docs.groupBy("item_type").agg(
        F.count("text_length").alias("n"), F.avg("text_length").alias("mean"), F.min("text_length").alias("min"),
        F.max("text_length").alias("max"))
    median = exact_quantiles(docs, "text_length", {"median": 0.5}, ["item_type"], few_groups=True)  # three items
    return stats.join(median, "item_type", "left")


def check_schema(df: DataFrame, cols: Sequence[str], phase: str = "", prefix: bool = False) -> DataFrame:
    """Check row: are all required columns (or column prefixes) present?"""
    if prefix:
        missing = [c for c in cols if not any(x.startswith(c) for x in df.columns)]
    else:
        missing = [c for c in cols if c not in df.columns]
    return check(df.sparkSession, phase, "schema", not missing, ", ".join(missing) or "all present")


def check(spark: SparkSession, phase: str, name: str, passed: bool, detail: str, severity: str = "error") -> DataFrame:
    return spark.createDataFrame([(phase, name, bool(passed), severity, detail)], CHECK)


def check_from(df: DataFrame, phase: str, name: str, passed: Column, detail: Column, severity: str = "error") -> DataFrame:
    """Check rows from a measured table."""
    return df.select(
        F.lit(phase).alias("phase"), F.lit(name).alias("check"), passed.alias("passed"),
        F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))


class TableChecks:
    """Checks of one table that are all measured while it is read once.

    Sums and counts are observed metrics of the scan; counts by key, if asked for, are the aggregate that the
    scan feeds, so uniqueness and a distribution cost no further read. The driver sees one number per check and
    one per value of ``by``.
    """

    def __init__(self, df: DataFrame, phase: str):
        self.df, self.phase = df, phase
        self._metrics: dict[str, Column] = {"n": F.count(F.lit(1))}
        self._rules: list = []  # functions from the metrics to rows of CHECK
        self._keys: list[str] = []
        self._by: str | None = None

    def _add(self, name: str, severity: str, passed: Callable[[dict], bool], detail: Callable[[dict], object]) -> TableChecks:
        self._rules.append(lambda m: (self.phase, name, bool(passed(m)), severity, str(detail(m))))
        return self

    def has_columns(self, cols: Sequence[str], prefix: bool = False) -> TableChecks:
        missing = [c for c in cols if not any(x == c or prefix and x.startswith(c) for x in self.df.columns)]
        return self._add("schema", "error", lambda m: not missing, lambda m: ", ".join(missing) or "all present")

    def none_where(self, name: str, bad: Column, severity: str = "error") -> TableChecks:
        """No row meets ``bad``."""
        key = f"none {len(self._metrics)}"
        self._metrics[key] = F.count_if(F.coalesce(bad, F.lit(False)))
        return self._add(name, severity, lambda m: m[key] == 0, lambda m: m[key])

    def covered(self, col: str, minimum: float = 0.5, severity: str = "warning") -> TableChecks:
        """At least a share of ``minimum`` of the rows has a value; the detail is the percentage."""
        self._metrics[f"has {col}"] = F.count(col)
        share = lambda m: m[f"has {col}"] / m["n"] if m["n"] else 0.0
        return self._add(f"{col} coverage", severity, lambda m: share(m) >= minimum, lambda m: round(100 * share(m), 2))

    def as_many_as(self, name: str, other: TableChecks) -> TableChecks:
        """As many rows as another table, which is measured first."""
        return self._add(name, "error", lambda m: m["n"] == other.measured["n"], lambda m: m["n"])

    def unique(self, keys: Sequence[str], name: str = "unique keys") -> TableChecks:
        self._keys = list(keys)
        return self._add(name, "error", lambda m: m["duplicates"] == 0, lambda m: m["duplicates"])

    def counted(self, by: str, name: str) -> TableChecks:
        """Rows per value of a column with few values, for information."""
        self._by = by
        self._rules.append(lambda m: [(self.phase, name, True, "info", str(n)) for _, n in m["by"]])
        return self

    @cached_property
    def measured(self) -> dict:
        seen = Observation()
        df = self.df.observe(seen, *[c.alias(k) for k, c in self._metrics.items()])
        # distinct keys of each value of ``by``: one aggregate over the keys and one over its result
        groups = [*self._keys, *([self._by] if self._by and self._by not in self._keys else [])]
        counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_c"))
        by = [F.col(self._by).alias("by")] if self._by else [F.lit(None).alias("by")]
        rows = counts.groupBy(*by).agg(F.sum("_c").alias("n"), F.sum(F.col("_c") - 1).alias("d")).collect()
        # the planner may leave out the scan of an empty table, and its metrics with it; they are all counts
        found = seen.get if any(r["n"] for r in rows) else dict.fromkeys(self._metrics, 0)
        return found | {"duplicates": sum(r["d"] for r in rows if self._keys and r["d"]), "by": [(r["by"], r["n"]) for r in rows if r["n"]]}

    def rows(self) -> list[tuple]:
        out = []
        for rule in self._rules:
            found = rule(self.measured)
            out += found if isinstance(found, list) else [found]
        return out


def checks_table(spark: SparkSession, tables: Sequence[TableChecks]) -> DataFrame:
    """The checks of all tables as rows."""
    return spark.createDataFrame([r for t in tables for r in t.rows()], CHECK)


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls per required column."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in cols])))


def check_coverage(df: DataFrame, cols: Sequence[str], minimum: float = 0.5) -> DataFrame:
    """Coverage per column with a warning flag below ``minimum``."""
    return coverage(df, cols).withColumn("low", F.col("pct") < minimum * 100)


def check_text(df: DataFrame) -> DataFrame:
    """Empty texts, mean and median length."""
    n = F.length("text")
    stats = df.agg(
        F.count("*").alias("n"), F.count_if(F.col("text").isNull() | (n == 0)).alias("n_empty"),
        F.avg(n).alias("mean_length"))
    return stats.withColumn("median_length", exact_quantiles(df, n, {"median_length": 0.5}).scalar())


def item_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("item_type").agg(F.count("*").alias("n"))


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of rows beyond the first of each key."""
    return df.groupBy(*keys).agg(F.count("*").alias("_c")).agg(
        F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("n_duplicates"), F.count("*").alias("n_keys"))


def check_embeddings(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Vectors with NaN or infinite entries, dimensions, total."""
    v = F.col(vector)
    bad_nan = F.exists(v, lambda x: F.isnan(x))
    bad_inf = F.exists(v, lambda x: F.abs(x) == float("inf"))
    return df.agg(
        F.count("*").alias("n"), F.min(F.size(v)).alias("min_dim"), F.max(F.size(v)).alias("max_dim"),
        F.count_if(bad_nan).alias("n_nan"), F.count_if(bad_inf).alias("n_inf"))


def check_range(df: DataFrame, col: str, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Values outside [lo, hi]; meant as a warning, since novelty has no upper bound."""
    return df.agg(
        F.count(col).alias("n"), F.count_if(F.col(col) < lo).alias("n_below"), F.count_if(F.col(col) > hi).alias("n_above"))


def check_count_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row counts of two tables and whether they agree."""
    both = a.select(F.lit(1).alias("s")).unionAll(b.select(F.lit(2).alias("s")))
    return both.agg(
        F.count_if(F.col("s") == 1).alias("n_first"), F.count_if(F.col("s") == 2).alias("n_second")
    ).withColumn("match", F.col("n_first") == F.col("n_second"))


def key_coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the first table relative to those of the second."""
    both = a.select(F.lit(1).alias("s"), key).unionAll(b.select(F.lit(2).alias("s"), key)).distinct()
    return both.where(F.col(key).isNotNull()).agg(
        F.count_if(F.col("s") == 1).alias("n_first"), F.count_if(F.col("s") == 2).alias("n_second")
    ).withColumn("coverage", F.when(F.col("n_second") > 0, F.col("n_first") / F.col("n_second")).otherwise(0.0))


def alignment_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Keys in one table only, or with different columns in both."""
    x = a.select(*keys, F.struct(*cols).alias("_a"))
    y = b.select(*keys, F.struct(*cols).alias("_b"))
    j = x.join(y, list(keys), "full")
    state = F.when(F.col("_a").isNull(), "second only").when(F.col("_b").isNull(), "first only").otherwise("differs")
    diff = F.array_compact(F.array(*[F.when(~F.col("_a")[c].eqNullSafe(F.col("_b")[c]), F.lit(c)) for c in cols]))
    return j.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(
        *keys, state.alias("state"),
        F.when(state == "differs", F.array_join(diff, ",")).otherwise("").alias("columns"))


def check_alignment(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Number of mismatches per kind and column."""
    return alignment_differences(a, b, keys, cols).groupBy("state", "columns").agg(F.count("*").alias("n"))


def first_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str], n: int = 5) -> DataFrame:
    return alignment_differences(a, b, keys, cols).orderBy(*keys).limit(n)


def match_diagnosis(a: DataFrame, b: DataFrame, key: str = "accession_number") -> DataFrame:
    """Distinct keys in both tables, matches as they are and with hyphens removed."""
    def keys(df: DataFrame, side: int, form: str, k: Column) -> DataFrame:
        return df.where(F.col(key).isNotNull()).select(F.lit(side).alias("side"), F.lit(form).alias("form"), k.alias("k"))

    plain = F.col(key).cast("string")
    bare = F.replace(plain, F.lit("-"), F.lit(""))
    rows = reduce(DataFrame.unionAll, [
        keys(df, s, f, k) for s, df in ((1, a), (2, b)) for f, k in (("as is", plain), ("no hyphens", bare))])
    per_key = rows.groupBy("form", "k").agg(
        F.bool_or(F.col("side") == 1).alias("_a"), F.bool_or(F.col("side") == 2).alias("_b"))
    return per_key.groupBy("form").agg(
        F.count_if("_a").alias("n_first"), F.count_if("_b").alias("n_second"),
        F.count_if(F.col("_a") & F.col("_b")).alias("n_matches"))


def guarded_left_join(a: DataFrame, b: DataFrame, on: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Left join that cannot change the row count: the right side is reduced to one row per key."""
    return a.join(first_per_key(b, list(on), list(order)), list(on), "left")


def match_rate(joined: DataFrame, col: str) -> DataFrame:
    return joined.agg(
        F.count("*").alias("n"), F.count(col).alias("n_matched"), (F.count(col) / F.count("*")).alias("rate"))


def check_loss_log(log: DataFrame) -> DataFrame:
    """Points of a loss log, missing ones, and whether it is usable."""
    bad = F.col("loss").isNull() | F.isnan("loss")
    return log.agg(F.count("*").alias("n_points"), F.count_if(bad).alias("n_nan")).withColumn(
        "ok", (F.col("n_points") > 0) & (F.col("n_nan") == 0))


def validation_report(checks: DataFrame) -> DataFrame:
    """Status per phase and counts by severity of what did not pass."""
    failed = ~F.col("passed")
    return checks.groupBy("phase").agg(
        F.count("*").alias("n_checks"),
        F.count_if(failed & (F.col("severity") == "error")).alias("n_errors"),
        F.count_if(failed & (F.col("severity") == "warning")).alias("n_warnings"),
        F.count_if(F.col("severity") == "info").alias("n_info"),
    ).withColumn("status", F.when(F.col("n_errors") > 0, "failed").otherwise("passed"))


def run_summary(docs: DataFrame, sents: DataFrame) -> DataFrame:
    """Documents, sentences, filings and firms per item."""
    d = docs.groupBy("item_type").agg(
        F.count("*").alias("n_documents"), F.countDistinct("accession_number").alias("n_filings"),
        F.countDistinct("cik").alias("n_firms"))
    s = sents.groupBy("item_type").agg(F.count("*").alias("n_sentences"))
    return d.join(s, "item_type", "left").fillna(0, ["n_sentences"])
