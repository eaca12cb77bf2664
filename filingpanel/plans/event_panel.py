"""From returns and links to outcomes, controls and tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators import controls, eventstudy, regression, results


def outcome_panel(
    filings: DataFrame, links: DataFrame, returns: DataFrame, market: DataFrame, forecasts: DataFrame | None = None,
    days: Sequence[int] = (30, 60, 90), lookback: int = 30,
) -> DataFrame:
    """Filings linked at their date, with event-window outcomes and forecast revision."""
    linked = eventstudy.link_asof_interval(filings, links)
    abnormal = eventstudy.abnormal_returns(returns, market)
    out = eventstudy.event_outcomes(linked, abnormal, days, lookback)
    fc = None if forecasts is None else eventstudy.forecast_revision(linked, forecasts, lookback)
    return eventstudy.assemble_outcomes(linked, out, fc)


def control_panel(
    filings: DataFrame, monthly: DataFrame, daily: DataFrame, fundamentals: DataFrame, links: DataFrame
) -> DataFrame:
    """Winsorised controls per filing."""
    m = controls.clean_monthly(monthly)
    fund = controls.link_fundamentals(controls.book_equity(fundamentals), links, ["at", "be", "total_debt"])
    return controls.winsorize(controls.assemble_controls(
        filings, m, controls.momentum(m), controls.rolling_volatility(daily), fund), materialize=True)


def tested_coefficients(panel: DataFrame, outcome: str, base: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Robust coefficients of the features with false-discovery correction."""
    spark = panel.sparkSession
    fit = regression.ols(panel, outcome, [*base, *features])
    table = fit.table(spark, outcome=outcome).where(~results.F.col("term").isin("const", *base))
    return results.fdr_bh(table.withColumnRenamed("term", "feature"))
