"""From embeddings to selected concept features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.durable import durable
from ..operators import concepts, docpanel, regression
from ..operators.docpanel import DOC_KEY


def panel_columns(panel_features: DataFrame, features: Sequence[int]) -> DataFrame:
    """Mean and frequency columns of the listed features per document, zero where inactive."""
    wide = panel_features.groupBy(*DOC_KEY).pivot("feature_id", list(features)).agg(
        F.first("mean_activation").alias("mean"), F.first("freq_activation").alias("freq"))
    cols = [F.coalesce(F.col(f"{f}_{kind}"), F.lit(0.0)).alias(f"{kind}_{f}") for kind in ("mean", "freq") for f in features]
    return wide.select(*DOC_KEY, *cols)


def concept_panel(
    sents: DataFrame, model: concepts.KSparseEncoderModel, features: Sequence[int], q: float = 0.9, min_rate: float = 0.01
) -> DataFrame:
    """Document scores with the columns of the alive features among ``features``."""
    keys = ["accession_number", "sentence_id", "item_type"]
    # Rates, thresholds and features all read the activations: encode once.
    long = concepts.to_long(model.transform(sents.select(*keys, "embedding")), keys)
    long = concepts.alive_features(durable(long), sents, min_rate)
    wide = panel_columns(docpanel.document_features(sents, long, q), features)
    cols = [c for c in wide.columns if c not in DOC_KEY]
    return docpanel.document_scores(sents).join(wide, DOC_KEY, "left").fillna(0.0, cols)


def select_concepts(panel: DataFrame, outcomes: Sequence[str], controls: Sequence[str] = (), **kw) -> DataFrame:
    """Lasso over all concept columns; the panel is materialised, as several passes read it."""
    panel = durable(panel)
    names = [c for c in panel.columns if c.startswith(("mean_", "freq_"))]
    return regression.feature_selection(panel, outcomes, names, controls, **kw)
