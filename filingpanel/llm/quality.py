"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

A rule rejects a document whose statistic lies above a cutoff. The cutoffs are taken per stratum from labelled
documents: testing from the most lenient cutoff on, a cutoff is certified while the exact binomial test rejects
"more than ``alpha`` of the good documents of this stratum would be refused". Going in a fixed order needs no
correction within a rule; ``delta`` is divided by the number of (stratum, rule) sequences, and ``alpha`` among the
rules, so with probability 1 - delta no stratum loses more than ``alpha`` of its good documents. A stratum whose labels are
too few for a certificate, or that the labels do not know, is only judged by the base rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_of

# Cutoffs of each rule from lenient to strict, chosen without looking at the labels.
CUTOFFS = {
    "symbols": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02],
    "dup_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeats": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05],
    "long_words": [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0],
}
ALPHA, DELTA, MIN_WORDS = 0.02, 0.05, 50
GOOD_WEIGHT = 10.0  # a share of good documents refused weighs as much as ten times that share of bad ones kept
SPACE = r"[\x20\x09-\x0D]+"


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
             carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines`` per row, without a shuffle.

    ``carry`` names input columns that are passed on in a struct ``row``. Null text has no words. Three-word windows
    are compared as text, so the counts are exact; only texts with a repeated window are sorted.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("(none)")).alias("stratum"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []),
        text_of(text_col).alias("text"))
    keys = ["doc_id", "stratum", *(["row"] if carry else [])]
    bare = F.btrim("text", F.lit(" \t\n\x0b\f\r"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    one = base.select(
        *keys, F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE, -1)).alias("w"),
        lines.alias("lines"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"))
    w = F.col("w")
    grams = F.when(
        F.size(w) >= 3,
        F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.concat(x, F.lit(" "), w[i + 1], F.lit(" "), w[i + 2])),
    ).otherwise(F.array().cast("array<string>"))
    two = one.select(
        *keys, "n_symbols", F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), grams.alias("g"))
    g = F.col("g")
    three = two.select(
        *[c for c in two.columns if c != "g"],
        F.when(F.size(F.array_distinct(g)) < F.size(g),
               F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("p"))))).alias("s"))
    s = F.col("s")
    again = F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["g"] == x["g"])) | F.coalesce(F.get(s, j + 1)["g"] == x["g"], F.lit(False)))
    four = three.select(*[c for c in three.columns if c != "s"], F.array_sort(again["p"]).alias("p"))
    p = F.col("p")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    whole = F.struct(*[c for c in four.columns if c != "p"], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    # through a generator, so that a filter on a count is not pushed into the text expressions and computes them again
    return four.select(F.inline(F.array(whole)))


def statistics() -> dict[str, Column]:
    """The statistic of each rule; larger is worse."""
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return {"symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"),
            "repeats": share("n_repeat_words", "n_words"), "long_words": share("word_chars", "n_words")}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def log_factorial(n: Column) -> Column:
    """log(n!) by Stirling's series at n + 9, taken back by division; error below 1e-12."""
    x = n.cast("double") + 9
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    back = F.lit(0.0)
    for i in range(1, 9):
        back = back + F.log(n.cast("double") + i)
    return series - back


def binomial_tail(k: Column, n: Column, alpha: float) -> Column:
    """P(X <= k) for X binomial(n, alpha); 1 from the mean on.

    Terms are added from k downwards, where they shrink: the j-th one is at most exp(-j^2 / (2 n alpha)) of the first, so
    all beyond ten times sqrt(n alpha) are together below the precision of a double, for any n.
    """
    top = (log_factorial(n) - log_factorial(k) - log_factorial(n - k)
           + k * math.log(alpha) + (n - k) * math.log1p(-alpha))
    odds = (1 - alpha) / alpha
    terms = F.least(k, 40 + F.ceil(10 * F.sqrt(n * alpha)).cast("long"))
    step = F.aggregate(
        F.sequence(F.lit(0).cast("long"), terms),
        F.struct(F.lit(0.0).alias("total"), F.lit(1.0).alias("term")),
        lambda acc, j: F.struct((acc["total"] + acc["term"]).alias("total"),
                                (acc["term"] * (k - j) * odds / (n - k + j + 1)).alias("term")))
    return F.when(k >= n * alpha, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top + F.log(step["total"]))))


def thresholds(feats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``stratum`` and ``cut_<rule>`` (null: the rule refuses nothing there): a row per stratum with a certified cutoff.

    ``labels``: doc_id, quality (1 good, 0 bad; null ignored; of several labels of a document the lowest counts).
    All certified cutoffs keep the guarantee; the one with the largest share of bad documents caught, less ``GOOD_WEIGHT``
    times the share of good ones refused, is taken, the more lenient of equals.
    """
    rules, per_rule = list(CUTOFFS), alpha / len(CUTOFFS)
    marks = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    stats = statistics()
    levels = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.size(F.filter(F.array(*map(F.lit, CUTOFFS[r])), _below(stats[r]))).alias("refusals"))
        for r in rules])
    counts = staged(
        feats.where(~base_failed()).join(marks, "doc_id").select("stratum", (F.col("quality") > 0).alias("good"), F.explode(levels).alias("l"))
        .groupBy("stratum", "good", "l.rule", "l.refusals").agg(F.count(F.lit(1)).alias("n")), "quality-counts")

    n_strata = counts.where("good").agg(F.count_distinct("stratum")).scalar()
    steps = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r, len(CUTOFFS[r]))]), F.col("rule"))
    at = counts.withColumn("steps", steps).withColumn("step", F.explode(F.sequence(F.lit(1), F.col("steps"))))
    refused = F.col("refusals") > F.col("steps") - F.col("step")
    good = F.col("good")
    tested = at.groupBy("stratum", "rule", "step").agg(
        F.sum(F.when(good & refused, F.col("n")).otherwise(0)).alias("k"), F.sum(F.when(good, F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(~good & refused, F.col("n")).otherwise(0)).alias("caught"),
        F.sum(F.when(~good, F.col("n")).otherwise(0)).alias("n_bad"))
    level = delta / (n_strata * len(rules))
    order = Window.partitionBy("stratum", "rule").orderBy("step")
    certified = (
        tested.withColumn("p", F.when(F.col("n") > 0, binomial_tail(F.col("k"), F.col("n"), per_rule)).otherwise(1.0))
        .withColumn("failed", F.max(F.when(F.col("p") <= level, 0).otherwise(1)).over(order)).where("failed = 0 and caught > 0")
        .withColumn("use", F.col("caught") / F.col("n_bad") - GOOD_WEIGHT * F.col("k") / F.col("n")))
    cuts = F.element_at(F.create_map(*[x for r in rules for x in (F.lit(r), F.array(*map(F.lit, CUTOFFS[r])))]), F.col("rule"))
    best = F.max_by("step", F.struct("use", (-F.col("step")).alias("lenient")))
    chosen = certified.where("use > 0").groupBy("stratum", "rule").agg(best.alias("step")).withColumn("cut", F.element_at(cuts, F.col("step")))
    picked = chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(f"cut_{r}") for r in rules])
    return staged(picked, "quality-thresholds")


def _below(stat: Column):
    return lambda cut: stat > cut


def judged(feats: DataFrame, cuts: DataFrame) -> DataFrame:
    """``feats`` with ``base_failed`` and ``kept``. Strata without cutoffs of their own lose nothing beyond the base rules.

    ``cuts`` is a stored table of a few rows; the planner broadcasts it after looking at its size.
    """
    joined, stats, refused = feats.join(cuts, "stratum", "left"), statistics(), F.lit(False)
    for r in CUTOFFS:
        refused = refused | F.coalesce(stats[r] > F.col(f"cut_{r}"), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~refused)


def quality_verdicts(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document: the counts of ``features``, ``base_failed`` and ``kept``.

    Null or empty texts have no words and fail the base rule; a null language is a stratum of its own; repeated rows
    are judged each; without labels only the base rule refuses. An empty table gives an empty result.
    """
    feats = staged(features(docs), "quality-features")
    return judged(feats, thresholds(feats, labels, alpha, delta)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that are kept, with all their columns; the text is judged in place and never shuffled."""
    cuts = thresholds(staged(features(docs), "quality-features"), labels, alpha, delta)
    return judged(features(docs, carry=tuple(docs.columns)), cuts).where("kept").select("row.*")
