"""Result tables: false discovery rate, coefficient tables, tests, histograms and column statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.order import running_min_from_end, running_total
from ..functions.quantiles import exact_quantiles


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def fdr_bh(df: DataFrame, p_col: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values, rejection and marks.

    Equal p-values share one adjusted value, so the work is done per distinct
    p-value: running counts upwards, running minimum from the end, both without
    a window over the whole table.
    """
    counts = df.where(F.col(p_col).isNotNull()).groupBy(p_col).agg(F.count("*").alias("_c"))
    ranked = running_total(counts, [p_col], "_c", "_r")
    m = counts.agg(F.sum("_c").alias("m")).scalar()
    adjusted = running_min_from_end(ranked, [p_col], F.col(p_col) * m / F.col("_r"), "_q").select(
        p_col, F.least(F.col("_q"), F.lit(1.0)).alias("p_value_fdr"))
    return (
        df.join(adjusted, p_col, "left")
        .withColumn("significant_fdr", F.col("p_value_fdr") <= alpha)
        .withColumn("sig_fdr", stars(F.col("p_value_fdr")))
    )


def significance_counts(df: DataFrame, by: str = "outcome", alpha: float = 0.05) -> DataFrame:
    """Tests per outcome, significant ones before and after the correction."""
    return df.groupBy(by).agg(
        F.count("*").alias("n_tests"), F.count_if(F.col("p_value") < alpha).alias("n_raw"),
        F.count_if("significant_fdr").alias("n_fdr"))


def coefficient_table(fits: DataFrame, n: int = 15) -> DataFrame:
    """The largest coefficients with neuron, type (mean or freq) and marks."""
    return (
        fits.withColumn("abs_coefficient", F.abs("coefficient")).orderBy(F.desc("abs_coefficient"), "feature").limit(n)
        .select(
            "feature", F.element_at(F.split("feature", "_"), -1).alias("neuron"),
            F.when(F.col("feature").startswith("mean_"), "Mean").otherwise("Freq").alias("type"),
            "coefficient", "p_value", stars(F.col("p_value")).alias("sig"))
    )


def attention_test(fits: DataFrame) -> DataFrame:
    """Per outcome: is the off-pricing coefficient weaker than the on-pricing one?

    Weaker is the prediction for announcement returns, stronger that for drift.
    """
    def of(term: str, col: str) -> Column:
        return F.max(F.when(F.col("term") == term, F.col(col)))

    t = fits.groupBy("outcome").agg(
        of("on", "coefficient").alias("beta_on"), of("perp", "coefficient").alias("beta_perp"),
        of("on", "p_value").alias("p_on"), of("perp", "p_value").alias("p_perp"))
    weaker = F.abs("beta_perp") < F.abs("beta_on")
    announcement = F.col("outcome").isin("car_minus1_plus1", "announcement_return", "car_3d")
    return t.withColumn("off_pricing_weaker", weaker).withColumn(
        "verdict", F.when(F.when(announcement, weaker).otherwise(F.abs("beta_perp") > F.abs("beta_on")), "consistent")
        .otherwise("inconsistent"))


def coef_comparison(car: DataFrame, drift: DataFrame) -> DataFrame:
    """Coefficients of two outcomes side by side; missing ones are 0 with p = 1; by size of the drift one."""
    a = car.select("feature", F.col("coefficient").alias("coef_car"), F.col("p_value").alias("pval_car"))
    b = drift.select("feature", F.col("coefficient").alias("coef_drift"), F.col("p_value").alias("pval_drift"))
    fill = {"coef_car": 0.0, "coef_drift": 0.0, "pval_car": 1.0, "pval_drift": 1.0}
    return a.join(b, "feature", "full").fillna(fill).withColumn("abs_drift", F.abs("coef_drift")).orderBy(
        F.desc("abs_drift"), "feature")


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last bin is closed."""
    known = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("_x"))
    lo = known.agg(F.min("_x").alias("v")).scalar()
    hi = known.agg(F.max("_x").alias("v")).scalar()
    pos = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))
    cell = F.least(F.coalesce(pos, F.lit(0)), F.lit(bins - 1)).cast("int")
    width = (F.col("_hi") - F.col("_lo")) / bins
    return (
        known.withColumn("_lo", lo).withColumn("_hi", hi).groupBy(cell.alias("bin"), "_lo", "_hi")
        .agg(F.count("*").alias("n"))
        .select("bin", (F.col("_lo") + F.col("bin") * width).alias("left_edge"), "n")
    )


def yearly_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.where(F.col("year").isNotNull()).groupBy("year").agg(*[F.avg(c).alias(c) for c in cols])


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])
    return df.select(*by, F.inline(pairs))


def summary_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, quartiles and max per column."""
    long = _long(df, cols)
    basic = long.groupBy("column").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
        F.max("x").alias("max"))
    return basic.join(exact_quantiles(long, "x", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["column"], few_groups=True), "column", "left")


def column_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, std, range, nulls and share of non-zero values per column."""
    return _long(df, cols).groupBy("column").agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.count_if(F.col("x").isNull()).alias("n_null"),
        (F.count_if(F.col("x") != 0) / F.count("*")).alias("nonzero_share"))


def normality_share(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share within one and two standard deviations; both near the normal values hint at placeholder data."""
    long = _long(df, cols).where(F.col("x").isNotNull())
    base = long.groupBy("column").agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    z = F.abs((F.col("x") - F.col("_m")) / F.col("_s"))
    # one row per named column
    shares = long.join(F.broadcast(base), "column").groupBy("column").agg(
        F.avg(F.when(z <= 1, 1.0).otherwise(0.0)).alias("within_1"),
        F.avg(F.when(z <= 2, 1.0).otherwise(0.0)).alias("within_2"))
    normal = (F.col("within_1") > 0.65) & (F.col("within_1") < 0.71) & (F.col("within_2") > 0.93) & (
        F.col("within_2") < 0.97)
    return shares.withColumn("verdict", F.when(normal, "looks like random noise").otherwise("deviates from normal"))


def top_correlations(corr: DataFrame, n: int = 10) -> DataFrame:
    """Features of largest absolute correlation."""
    return corr.withColumn("abs_correlation", F.abs("correlation")).orderBy(
        F.desc_nulls_last("abs_correlation"), "feature").limit(n)


def correlation_summary(corr: DataFrame) -> DataFrame:
    """Maximum, median and mean absolute correlation."""
    a = corr.select(F.abs("correlation").alias("_a"))
    med = exact_quantiles(a, "_a", {"median_abs": 0.5}).scalar()
    return a.agg(F.max("_a").alias("max_abs"), F.avg("_a").alias("mean_abs")).withColumn("median_abs", med)


def feature_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Features in both lists, only in the first, only in the second."""
    x = a.select("feature").distinct().withColumn("_a", F.lit(True))
    y = b.select("feature").distinct().withColumn("_b", F.lit(True))
    where = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(
        F.col("_a").isNotNull(), "first only").otherwise("second only")
    return x.join(y, "feature", "full").select("feature", where.alias("found_in"))


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def grade(df: DataFrame, p_col: str = "f_pval") -> DataFrame:
    """Verbal grade of a p-value."""
    p = F.col(p_col)
    return df.withColumn(
        "grade", F.when(p < 0.01, "significant at 1%").when(p < 0.05, "significant at 5%")
        .when(p < 0.10, "marginal at 10%").otherwise("not significant"))


# Expected sign per control; leverage is open.
EXPECTED_SIGNS = {"size": -1, "bm": 1, "past_ret": 1, "past_vol": -1, "leverage": 0}


def control_sign_check(fits: DataFrame) -> DataFrame:
    """Observed against expected sign of each control coefficient."""
    expected = F.create_map(*[F.lit(v) for kv in EXPECTED_SIGNS.items() for v in kv])
    sign = F.signum("coefficient").cast("int")
    return fits.where(F.col("term").isin(*EXPECTED_SIGNS)).withColumn("expected", expected[F.col("term")]).withColumn(
        "verdict", F.when(F.col("expected") == 0, "open").when(sign == F.col("expected"), "as expected")
        .otherwise("opposite"))
