"""Explicit schemas of every table that is read or written."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


TEXT, INT, LONG, DOUBLE, FLAG = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
)
TEXTS = T.ArrayType(TEXT)

QUERIES = _struct(("query_url", TEXT), ("status", TEXT), ("search_volume", DOUBLE))

LISTINGS = _struct(
    ("listing_link", TEXT), ("position", TEXT), ("name", TEXT), ("categories", TEXT),
    ("website", TEXT), ("phone", TEXT), ("address", TEXT), ("reviews_count", LONG),
    ("rating", DOUBLE), ("status", TEXT), ("source_file", TEXT), ("search_volume", DOUBLE),
)

EVALUATIONS = _struct(
    ("listing_link", TEXT), ("eval_rating", TEXT), ("eval_time", T.TimestampType()), ("notes", TEXT)
)

# What a page parser reports for one listing container: element texts and attributes only.
LISTING_MARKUP = _struct(
    ("link_href", TEXT), ("link_label", TEXT), ("headline", TEXT), ("rating_text", TEXT),
    ("reviews_text", TEXT), ("category_texts", TEXTS),
    ("blocks", T.ArrayType(_struct(("text", TEXT), ("phone", TEXT)))),
    ("has_website_anchor", FLAG), ("website_href", TEXT),
)

PANEL_MARKUP = _struct(
    ("company", TEXT), ("badge", TEXT),
    ("rows", T.ArrayType(_struct(("label", TEXT), ("value", TEXT)))),
)

PAGE_MARKUP = _struct(
    ("text", TEXT), ("full_text", TEXT), ("title", TEXT), ("h1_count", INT), ("img_count", INT),
    ("metas", T.ArrayType(_struct(("name", TEXT), ("property", TEXT), ("content", TEXT)))),
    ("scripts", T.ArrayType(_struct(("src", TEXT), ("body", TEXT)))),
    ("styles", TEXTS), ("stylesheets", TEXTS), ("marked_attributes", TEXTS),
)

HTTP_POLICY = _struct(
    ("domain", TEXT), ("http_allowed", FLAG), ("redirects_to_https", FLAG), ("ssl_bad", FLAG),
    ("status_code", INT), ("error", TEXT), ("https_status_code", INT), ("ssl_error", TEXT), ("https_error", TEXT),
)

# Capture tables that stand where a live probe would be.
FETCH_LOG = _struct(
    ("page_id", LONG), ("scheme", TEXT), ("method", TEXT), ("requested_url", TEXT), ("final_url", TEXT),
    ("status_code", INT), ("error_kind", TEXT), ("last_modified", TEXT), ("load_seconds", DOUBLE),
    ("fetched_at", T.TimestampType()), ("error_text", TEXT), ("performance_timing", TEXT),
)
PAGES = _struct(("page_id", LONG), ("url", TEXT), ("html", TEXT))
CSS_CAPTURE = _struct(("css_url", TEXT), ("status_code", INT), ("body", TEXT), ("fetched_at", T.TimestampType()))
SITEMAP_CAPTURE = _struct(("url", TEXT), ("status_code", INT), ("content_type", TEXT), ("body", TEXT), ("fetched_at", T.TimestampType()))
PANEL_CAPTURE = _struct(("page_id", LONG), ("position", INT), ("panel_html", TEXT), ("image_src", TEXT))

# Columns the score reads; a table may lack any of them.
SITE_METRICS = _struct(
    ("isHttpAllowed", HTTP_POLICY), ("framework", TEXTS),
    ("genericTitle", _struct(("title", TEXT), ("is_generic", FLAG))),
    ("speedMetrics", _struct(("url", TEXT), ("load_time_seconds", DOUBLE), ("performance_timing", TEXT))),
    ("lastUpdate", _struct(("last_modified_header", TEXT), ("meta_date", TEXT),
                           ("latest_year_in_text", INT), ("has_updated_phrase", FLAG))),
    ("images", INT), ("words", INT), ("usesJs", FLAG), ("domain", TEXT),
    ("sitemap", _struct(("domain", TEXT), ("sitemap_found", TEXT), ("total_pages", INT))),
    ("siteBuilder", _struct(("builders_detected", TEXTS))),
    ("jquery", FLAG), ("analytics", FLAG), ("responsive", FLAG), ("metaDescription", FLAG),
    ("h1", FLAG), ("favicon", FLAG), ("html5", FLAG), ("phoneStartsWithPlus", FLAG),
    ("hasPhone", FLAG), ("hasAddress", FLAG), ("gbp_is_verified", FLAG), ("n_categories", INT),
    ("gbp_has_image", FLAG), ("attributes", INT), ("gbp_amount_of_attributes", INT),
    ("has_website", FLAG),
)
