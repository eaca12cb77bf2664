"""Registered queries: each operator on the given tables, with an independent SQL text."""

from __future__ import annotations

from .registry import oracle_sql, queries  # noqa: F401
from . import (  # noqa: F401  (importing registers the queries)
    sources_q, prepare_q, sampling_q, scoring_q, concepts_q, docpanel_q, eventstudy_q,
    regression_q, pricing_q, interpret_q, quality_q, plans_q,
)
