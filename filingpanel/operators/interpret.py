"""Concept interpretation: example sentences, prompts, labels and their fidelity."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.durable import durable
from ..functions.quantiles import sparse_quantile
from ..functions.sampling import cap_per_group, hash_rank, lowest_ranked
from .textscore import SENTENCE_KEY


def _of(long: DataFrame, features: Sequence[int]) -> DataFrame:
    return long.where(F.col("feature_id").isin(*features))


def high_examples(
    long: DataFrame, sents: DataFrame, features: Sequence[int], q: float = 0.95, n: int = 20, seed: int = 42
) -> DataFrame:
    """At most ``n`` random sentences per feature with an activation above its ``q`` quantile."""
    act = _of(long, features)
    thr = sparse_quantile(act, sents, "feature_id", "value", q, "threshold")
    above = act.join(F.broadcast(thr), "feature_id").where(F.col("value") > F.col("threshold"))  # a row per feature
    picked = cap_per_group(above.drop("threshold"), ["feature_id"], n, hash_rank(seed, *SENTENCE_KEY))
    return _with_text(picked, sents, seed)


def low_examples(
    long: DataFrame, sents: DataFrame, features: Sequence[int], q: float = 0.05, n: int = 20, seed: int = 42
) -> DataFrame:
    """At most ``n`` random sentences per feature without activation.

    With fewer than ``n`` such sentences the rows up to the ``q`` quantile are
    used instead.  Zeros are not stored: a sentence gives the wanted features
    that are missing from its active ones, in the walk of ``first_zeros``.
    """
    features = list(features)
    act = _of(long, features)
    total = sents.count()
    active = {r["feature_id"]: r["c"] for r in act.groupBy("feature_id").agg(F.count("*").alias("c")).collect()}
    plenty = [f for f in features if total - active.get(f, 0) >= n]
    scarce = [f for f in features if f not in plenty]
    rank = hash_rank(seed, *SENTENCE_KEY)

    out = first_zeros(sents, act, {f: total - active.get(f, 0) for f in features}, n, rank)
    if scarce:
        thr = sparse_quantile(_of(act, scarce), sents, "feature_id", "value", q, "threshold")
        below = act.join(F.broadcast(thr), "feature_id").where(F.col("value") <= F.col("threshold"))
        out = out.unionByName(below.select(*SENTENCE_KEY, "feature_id", "value"))
    return _with_text(cap_per_group(out, ["feature_id"], n, rank), sents, seed)


SURE = 10.0  # standard deviations by which the first range of a feature exceeds the rows it needs


def first_zeros(sents: DataFrame, act: DataFrame, zeros: dict[int, int], n: int, rank: Column) -> DataFrame:
    """``SENTENCE_KEY, feature_id, value`` of sentences without activation: for each feature at least its ``n`` of lowest rank,
    or all it has.  ``zeros``: their number per feature.

    Sentences are walked in the order of their hash.  A feature looks at a range of hashes that holds about ``n`` of its
    zeros, and leaves with it once they are found; otherwise its range is widened.  So pairs of a sentence and
    a feature are made for some ``n`` / (share of zeros) sentences per feature, not for all.
    """
    sents = sents.select(*SENTENCE_KEY, (F.conv(F.substring(rank, 1, 13), 16, 10).cast("double") / 16.0 ** 13).alias("_u"))
    act = act.select(*SENTENCE_KEY, F.col("feature_id").cast("int").alias("feature_id"), (F.conv(F.substring(rank, 1, 13), 16, 10).cast("double") / 16.0 ** 13).alias("_u"))
    limits = {f: min(1.0, (n + SURE * n ** 0.5 + SURE) / max(z, 1)) for f, z in zeros.items()}
    found = []
    while limits:
        near = F.col("_u") <= max(limits.values())
        active = act.where(near).groupBy(*SENTENCE_KEY).agg(F.collect_set("feature_id").alias("_on"))  # at most k per sentence
        wanted = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(limit).alias("limit")) for f, limit in sorted(limits.items())])
        within = F.transform(F.filter(wanted, lambda w: F.col("_u") <= w["limit"]), lambda w: w["f"])
        missing = F.array_except(within, F.coalesce("_on", F.array().cast("array<int>")))
        pairs = durable(sents.where(near).join(active, SENTENCE_KEY, "left").select(
            *SENTENCE_KEY, F.explode(missing).alias("feature_id"), F.lit(0.0).alias("value")))
        have = {r["feature_id"]: r["c"] for r in pairs.groupBy("feature_id").agg(F.count(F.lit(1)).alias("c")).collect()}
        done = [f for f, limit in limits.items() if limit >= 1.0 or have.get(f, 0) >= n]
        found.append(pairs.where(F.col("feature_id").isin(*done)))
        limits = {f: min(1.0, 4 * limit) for f, limit in limits.items() if f not in done}
    return reduce(DataFrame.unionByName, found)


def _with_text(picked: DataFrame, sents: DataFrame, seed: int) -> DataFrame:
    order = Window.partitionBy("feature_id").orderBy(hash_rank(seed, *SENTENCE_KEY))  # at most n rows each
    return picked.join(sents.select(*SENTENCE_KEY, "text"), SENTENCE_KEY).withColumn(
        "example", F.row_number().over(order))


def interpretation_prompts(high: DataFrame, low: DataFrame, shown: int = 10, width: int = 200) -> DataFrame:
    """Prompt per feature from the first examples of both kinds; features lacking one kind are skipped."""
    def block(df: DataFrame, name: str) -> DataFrame:
        line = F.concat(F.col("example").cast("string"), F.lit(". "), F.substring("text", 1, width), F.lit("..."))
        rows = df.where(F.col("example") <= shown).groupBy("feature_id").agg(
            F.sort_array(F.collect_list(F.struct("example", line.alias("line")))).alias("_r"))
        return rows.select("feature_id", F.array_join(F.col("_r.line"), "\n").alias(name))

    text = F.concat(
        F.lit("Sentences that activate feature "), F.col("feature_id").cast("string"), F.lit(":\n"), F.col("high"),
        F.lit("\n\nSentences that do not:\n"), F.col("low"),
        F.lit("\n\nName the pattern shared by the first group and absent from the second in one or two sentences."))
    return block(high, "high").join(block(low, "low"), "feature_id").withColumn("prompt", text)


def describe_concepts(prompts: DataFrame, labeller: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """A description per prompt.

    ``labeller`` is a plug point: it is called once per task and returns a
    function from prompts to descriptions.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label = labeller()
        for pdf in batches:
            yield pd.DataFrame({"feature_id": pdf["feature_id"], "description": label(pdf["prompt"].tolist())})

    return prompts.select("feature_id", "prompt").mapInPandas(run, "feature_id int, description string")


def evaluation_sample(sents: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """``n`` random sentences of all, or all if there are fewer."""
    return lowest_ranked(sents, n, hash_rank(seed, *SENTENCE_KEY))


def fidelity(df: DataFrame, by: str = "feature_id", truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Precision, recall and F1 per feature; zero where undefined."""
    t, p = F.col(truth), F.col(pred)
    counts = df.groupBy(by).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"),
        F.count("*").alias("n_eval"))

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    prec, rec = F.col("precision"), F.col("recall")
    return (
        counts.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn("f1", share(2 * prec * rec, prec + rec)).drop("tp", "fp", "fn"))


def high_fidelity(interpretations: DataFrame, scores: DataFrame, minimum: float = 0.7, by: str = "feature_id") -> DataFrame:
    return interpretations.join(scores.where(F.col("f1") > minimum).select(by), by, "left_semi")


def activation_column(feature: Column) -> Column:
    """``mean_M..`` and ``freq_M..`` refer to the activation ``h_M..``; other names stay."""
    return F.regexp_replace(feature, "^(mean|freq)_M", "h_M")


def activation_columns(lasso: DataFrame) -> DataFrame:
    """The distinct activation columns behind the selected features."""
    return lasso.select(activation_column(F.col("feature")).alias("activation")).distinct()


def outcomes_to_interpret(lasso: DataFrame) -> DataFrame:
    """Outcomes with at least one selected feature."""
    return lasso.groupBy("outcome").agg(F.count("*").alias("n_features_selected"))


def top_features(lasso: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest coefficients of each outcome."""
    w = Window.partitionBy("outcome").orderBy(F.desc(F.abs("coefficient")), "feature")
    return lasso.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def interpretation_summary(lasso: DataFrame, interpreted: DataFrame, kept: DataFrame) -> DataFrame:
    """Per outcome: features selected, interpreted, and kept for their fidelity."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("outcome").agg(F.count("*").alias(name))

    return (
        outcomes_to_interpret(lasso).join(count(interpreted, "n_interpreted"), "outcome", "left")
        .join(count(kept, "n_high_fidelity"), "outcome", "left").fillna(0))
