"""Captured site pages -> signals -> score."""

from __future__ import annotations

from pyspark.sql import DataFrame

from prospectry.operators import profile, scoring
from prospectry.session import materialize


def profile_and_score(
    listings: DataFrame, rendered: DataFrame, raw: DataFrame, fetch_log: DataFrame,
    css_capture: DataFrame, sitemap_capture: DataFrame, as_of_year: int,
) -> DataFrame:
    """Every listing with its signals, score and reasons. Page signals are written once and reused."""
    signals = materialize(profile.page_signals(rendered), "page-signals")
    metrics = profile.site_profile(listings, signals, raw, fetch_log, css_capture, sitemap_capture)
    return scoring.quality_score(metrics, as_of_year)
