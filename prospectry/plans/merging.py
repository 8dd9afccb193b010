"""Result lists -> merged table, source statuses and counts."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from prospectry.constants import DEFAULT_MIN_RATING
from prospectry.operators import merge


class Merged(NamedTuple):
    combined: DataFrame
    sources: DataFrame
    summary: DataFrame


def merge_lists(
    rows: DataFrame, files: Sequence[str], min_rating: float = DEFAULT_MIN_RATING, extra_first: Sequence[str] = (), flags: bool = True
) -> Merged:
    """``rows`` come from :func:`prospectry.sources.readers.scan_with_provenance`.

    The rating test is per appearance and runs before the merge; a business that survives
    through one appearance marks all its source rows as used. ``flags`` adds a column per input.
    """
    listings = merge.normalize_listings(rows)
    survivors = merge.filter_min_rating(listings, min_rating)
    merged = merge.merge_listings(survivors, files, extra_first, flags)
    combined = merge.combined_projection(merged, files, extra_first, flags)
    # Which links survive is known without gathering any appearance.
    sources = merge.mark_included(rows, merge.distinct_links(survivors))
    return Merged(combined, sources, merge.dedup_summary(listings, min_rating))
