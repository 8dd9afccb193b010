"""Query list and captured result pages -> one results table per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prospectry.functions.urls import query_slug
from prospectry.operators import listings as ex, searches


def collect_listings(
    queries: DataFrame, pages: DataFrame, panels: DataFrame, redo: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``queries`` has ``page_id, query_url, status, search_volume, source_file, ord``; ``pages``
    and ``panels`` are the captures. Returns listing rows with their slug, and query outcomes.
    """
    chosen = searches.select_pending(queries, redo).withColumn("slug", query_slug(F.col("query_url")))
    # Queries with one slug write one table: pick the last that has a page.
    arrived = chosen.join(pages.select("page_id"), "page_id", "left_semi")
    winners = searches.last_query_per_slug(arrived.select("slug", "ord", "page_id", "search_volume", "source_file"))
    # Only pages and panels of chosen queries are parsed. Their ids are the small side; measured
    # small, they are broadcast and the HTML is read where it lies.
    wanted = winners.select("page_id")
    found = ex.merge_panel_fields(
        ex.extract_listings(pages.select("page_id", "html").join(wanted, "page_id", "left_semi")),
        ex.extract_panels(panels.join(wanted, "page_id", "left_semi")),
    )
    rows = found.join(winners, "page_id")
    outcomes = searches.query_outcomes(queries, pages, redo, ["page_id"])
    return rows, outcomes
