"""One wide row of signals per business site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prospectry.functions.text import is_blank
from prospectry.functions.urls import site_urls
from prospectry.operators import captures, site


def contact_flags() -> dict[str, Column]:
    phone = F.coalesce("phone", F.lit(""))
    return {
        "phoneStartsWithPlus": phone.startswith("+"),
        "hasPhone": phone != "",
        "hasAddress": F.coalesce("address", F.lit("")) != "",
        "n_categories": F.coalesce(F.size("categories"), F.lit(0)),
    }


def listing_signals() -> dict[str, Column]:
    """Signals of the listing itself; unknown means the plain default of each."""
    return {
        **contact_flags(),
        "gbp_is_verified": F.coalesce("gbp_is_verified", F.lit(False)),
        "gbp_has_image": F.coalesce("gbp_has_image", F.lit(False)),
        "attributes": F.coalesce("attributes", F.lit(-1)),
        "has_website": ~is_blank(F.col("website")),
    }


def page_signals(rendered: DataFrame, captured: Column | None = None) -> DataFrame:
    """Every signal one rendered page gives, without its HTML.

    The profile reads this table twice, so write it out first when pages are many; parsing is
    the dear step.
    """
    features = site.page_features(rendered.withColumn("source", site.source_signals(F.col("html"))))
    metrics = {**site.page_metrics(F.col("source"), captured), **site.layout_signals()}
    page = F.struct(*[F.col(f"page.{n}").alias(n) for n in ("metas", "text", "full_text")])
    return features.select(
        "page_id", "url", site_urls(F.col("url"))["domain"].alias("domain"),
        *[c.alias(n) for n, c in metrics.items()],
        site.last_update(page, F.lit(None).cast("string")).alias("lastUpdate"),
    )


def site_profile(
    listings: DataFrame, signals: DataFrame, raw: DataFrame, fetch_log: DataFrame,
    css_capture: DataFrame, sitemap_capture: DataFrame,
) -> DataFrame:
    """Listing signals left-joined to page, fetch, style-sheet and sitemap signals.

    Every join is on ``page_id``, so a wide row moves once, to the partition of its page. What belongs to a domain comes
    to its pages through a narrow (page_id, domain) look-up. Pages travel to the joins as signals, never as HTML.
    Sitemaps are judged per domain, once.
    """
    raw_page = site.page_features(raw.select("page_id", "html", site.is_html5(F.col("html")).alias("html5"))).select(
        "page_id", site.words(F.col("page")).alias("_raw_words"), "html5"
    )
    responsive = site.is_responsive(signals, css_capture, site.base_url(F.col("url")))
    sitemaps = captures.check_sitemaps(captures.domains_of(signals), sitemap_capture)
    sitemap = F.struct("domain", "sitemap_found", "total_pages").alias("sitemap")
    of_page = signals.select("page_id", "domain").join(sitemaps, "domain", "left").select("page_id", sitemap)
    joined = (
        signals.join(raw_page, "page_id", "left").join(responsive, "page_id", "left")
        .join(captures.fetch_summary(fetch_log), "page_id", "left")
        .withColumns(
            {
                "isHttpAllowed": captures.http_policy(F.col("domain")),
                "speedMetrics": captures.load_time(F.col("url")),
                "lastUpdate": F.col("lastUpdate").withField("last_modified_header", F.col("last_modified")),
                "usesJs": F.col("words") > F.col("_raw_words"),
            }
        )
        .join(of_page, "page_id", "left")
        .drop("url", "_raw_words", "http", "head", "get", "last_modified", "load_seconds", "viewport", "inline_media", "stylesheets")
    )
    own = listings.select("page_id", *[c.alias(n) for n, c in listing_signals().items()])
    return own.join(joined, "page_id", "left")
