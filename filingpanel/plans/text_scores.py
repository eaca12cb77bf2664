"""From raw text to scored filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.durable import durable
from ..operators import docpanel, prepare, sampling, textscore


def score_sentences(sents: DataFrame, materialize: bool = True) -> DataFrame:
    """Novelty and relevance of every sentence, tokenising each text once.

    The counters (no text) are written to the checkpoint folder, since both the
    firm baselines and the scores read them.
    """
    keys = [c for c in ("accession_number", "cik", "year", "filing_date", "item_type", "sentence_id", "sentence_length")
            if c in sents.columns]
    counted = textscore.token_counts(sents).select(
        *keys, "n_words", "n_numeric", "n_capitalised", "n_keywords", "diversity")
    if materialize:
        counted = durable(counted)
    base = counted.where(F.col("cik").isNotNull()).groupBy("cik").agg(
        F.avg("sentence_length").alias("firm_length"), F.avg("diversity").alias("firm_diversity"))
    return (
        counted.join(base, "cik")
        .withColumn("novelty_cln", textscore.novelty_score()).withColumn("relevance_kmnz", textscore.relevance_score())
        .select(*keys, "novelty_cln", "relevance_kmnz")
    )


def filing_scores(docs: DataFrame) -> DataFrame:
    """Relevance-weighted novelty per document, from text."""
    return docpanel.document_scores(score_sentences(prepare.sentence_table(docs)))


def sampled_sentences(docs: DataFrame, **caps) -> DataFrame:
    """Sentence table after the three-stage sampler."""
    return sampling.stratified_sample(prepare.sentence_table(docs), **caps)
