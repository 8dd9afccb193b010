"""Importing this module fills the registry."""

from prospectry.catalog import (  # noqa: F401
    jobs, listing_pages, merging, reviewing, scores, searching, site_signals, tables, values,
)
from prospectry.catalog.registry import CHECK_SQL, QUERIES  # noqa: F401
