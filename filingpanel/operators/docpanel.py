"""Document panel: sentence scores and activations aggregated to filings, outcome and control joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vectors as vx
from ..functions.order import global_index
from ..functions.durable import durable
from ..functions.quantiles import exact_quantiles, sparse_quantile
from .prepare import first_per_key
from .textscore import SENTENCE_KEY

DOC_KEY = ["accession_number", "item_type"]
CONTROLS = ["size", "bm", "leverage", "past_ret", "past_vol"]


def feature_thresholds(long: DataFrame, sents: DataFrame, q: float = 0.9) -> DataFrame:
    """Global ``q`` quantile per feature over all sentences, zeros included."""
    return sparse_quantile(long, sents, "feature_id", "value", q, "threshold")


def _weighted() -> Column:
    both = F.col("novelty_cln").isNotNull() & F.col("relevance_kmnz").isNotNull()
    num = F.coalesce(F.sum(F.when(both, F.col("novelty_cln") * F.col("relevance_kmnz"))), F.lit(0.0))
    den = F.coalesce(F.sum(F.when(both, F.col("relevance_kmnz"))), F.lit(0.0))
    return num / F.greatest(den, F.lit(1e-8))


def weighted_novelty(sents: DataFrame) -> DataFrame:
    """Relevance-weighted novelty per document; sentences missing either score are left out."""
    return sents.groupBy(*DOC_KEY).agg(_weighted().alias("novelty_cln_weighted"))


def _first_known(col: str) -> Column:
    return F.min_by(col, F.when(F.col(col).isNotNull(), F.col("sentence_id")))


def document_scores(sents: DataFrame) -> DataFrame:
    """Year, cik, novelty and relevance aggregates and sentence count per document, one aggregate."""
    return sents.groupBy(*DOC_KEY).agg(
        _first_known("year").alias("year"), _first_known("cik").alias("cik"),
        F.avg("novelty_cln").alias("novelty_cln_mean"), F.max("novelty_cln").alias("novelty_cln_max"),
        _weighted().alias("novelty_cln_weighted"), F.avg("relevance_kmnz").alias("relevance_kmnz_mean"),
        F.count("*").alias("n_sentences"),
    )


def document_meta(sents: DataFrame) -> DataFrame:
    """``document_scores`` with a dense ``doc_id`` in key order."""
    return global_index(document_scores(sents), DOC_KEY, "doc_id")


def document_features(
    sents: DataFrame, long: DataFrame, q: float = 0.9, thresholds: DataFrame | None = None
) -> DataFrame:
    """Mean activation and share of sentences above the threshold per document and active feature.

    Long form: a (document, feature) pair without activation is zero in both and
    is not stored.  The sums are pre-aggregated before the shuffle on
    (document, feature); means divide by all sentences of the document.
    """
    thr = thresholds if thresholds is not None else feature_thresholds(long, sents, q)
    counts = sents.groupBy(*DOC_KEY).agg(F.count("*").alias("n_sentences"))
    # Thresholds: one row per feature of the model.
    sums = long.join(F.broadcast(thr), "feature_id").groupBy(*DOC_KEY, "feature_id").agg(
        F.sum("value").alias("_sum"), F.count_if(F.col("value") > F.col("threshold")).alias("_above")
    )
    return sums.join(counts, DOC_KEY).select(
        *DOC_KEY, "feature_id",
        (F.col("_sum") / F.col("n_sentences")).alias("mean_activation"),
        (F.col("_above") / F.col("n_sentences")).alias("freq_activation"),
    )


def document_panel(sents: DataFrame, long: DataFrame, q: float = 0.9) -> DataFrame:
    """Document scores with their features as a list of (feature_id, mean, freq).

    The activations are stored first: thresholds and sums read them, and the encoder shall run once.
    """
    long = durable(long)
    feats = document_features(sents, long, q)
    packed = feats.groupBy(*DOC_KEY).agg(  # at most one entry per feature of the model
        F.sort_array(F.collect_list(F.struct(
            "feature_id", F.col("mean_activation").alias("mean"), F.col("freq_activation").alias("freq")
        ))).alias("features")
    )
    return document_meta(sents).join(packed, DOC_KEY, "left")


def filing_representation(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Mean vector per (accession, cik, filing date)."""
    return df.groupBy("accession_number", "cik", "filing_date").agg(
        vx.mean_vector(vx.as_double(F.col(vector))).alias("z"), F.count("*").alias("n_sentences")
    )


def align_embeddings(sents: DataFrame, emb: DataFrame, item: str | None = None) -> DataFrame:
    """Sentences with their embedding, matched by key."""
    if item is not None:
        sents = sents.where(F.col("item_type") == item)
    return sents.join(emb.select(*SENTENCE_KEY, "embedding"), SENTENCE_KEY)


def _attach(panel: DataFrame, right: DataFrame, cols: list[str], order: list[str]) -> DataFrame:
    key = ["accession_number"]
    one = first_per_key(right.select(*key, *cols, *[o for o in order if o not in cols + key]), key, order)
    return panel.drop(*cols).join(one.select(*key, *cols), key, "left")


def attach_outcomes(panel: DataFrame, outcomes: DataFrame, cols: list[str], order: list[str]) -> DataFrame:
    """Left-join outcomes, one row per accession (first by ``order``), so the row count cannot change."""
    if "car_minus1_plus1" in cols:
        outcomes = outcomes.withColumnRenamed("car_minus1_plus1", "car_3d")
        cols = ["car_3d" if c == "car_minus1_plus1" else c for c in cols]
        order = ["car_3d" if c == "car_minus1_plus1" else c for c in order]
    return _attach(panel, outcomes, cols, order)


def attach_controls(panel: DataFrame, controls: DataFrame, order: list[str]) -> DataFrame:
    """Left-join the five controls, one row per accession."""
    return _attach(panel, controls, CONTROLS, order)


def merge_outcomes_controls(outcomes: DataFrame, controls: DataFrame) -> DataFrame:
    """Inner join on (accession, permno); columns in both come from the outcomes."""
    keys = ["accession_number", "permno"]
    new = [c for c in controls.columns if c not in outcomes.columns]
    return outcomes.join(controls.select(*keys, *new), keys)


def concept_profile(long: DataFrame, sents: DataFrame) -> DataFrame:
    """Mean novelty and relevance where a concept is active, its quadrant, and its share by item."""
    scored = long.where(F.col("value") > 0).join(
        sents.select(*SENTENCE_KEY, "novelty_cln", "relevance_kmnz"), SENTENCE_KEY
    )
    prof = scored.groupBy("feature_id").agg(
        F.avg("novelty_cln").alias("novelty"), F.avg("relevance_kmnz").alias("relevance"),
        F.count("*").alias("n_active"),
        *[F.avg(F.when(F.col("item_type") == i, 1.0).otherwise(0.0)).alias(f"share_{i}")
          for i in ("item1", "item1A", "item7")],
    )
    mid_n = exact_quantiles(prof, "novelty", {"m": 0.5}).scalar()
    mid_r = exact_quantiles(prof, "relevance", {"m": 0.5}).scalar()
    new, rel = F.col("novelty") >= mid_n, F.col("relevance") >= mid_r
    return prof.withColumn(
        "quadrant",
        F.when(new & rel, "novel relevant").when(new, "novel irrelevant").when(rel, "familiar relevant")
        .otherwise("familiar irrelevant"),
    )
