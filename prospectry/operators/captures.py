"""Signals that rest on captured responses: sitemaps, transport security, load time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prospectry.constants import SITEMAP_PATHS
from prospectry.functions.urls import site_urls

_SITEMAP_SCHEMA = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>, _malformed string"
_SITEMAP_OPTIONS = {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "_malformed"}

# What may stand before the root element of an XML text.
_PROLOG = r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|<![A-Za-z][^>]*>|\s)*<([^\s/>]+)"


def _fetched_at(captures: DataFrame) -> Column:
    """Time of a capture; captures without that column count as taken at one time."""
    return F.col("fetched_at") if "fetched_at" in captures.columns else F.lit(None).cast("timestamp")


def parse_sitemaps(captures: DataFrame) -> DataFrame:
    """Captured sitemaps as ``(ok, is_index, pages, children)``, one row per address.

    Of repeated captures of an address, a usable one (status 200, well formed) goes before others, so that
    a failed retry does not undo it; among equals the latest counts. Bodies are parsed where they are read. The shuffle that brings repeated captures of an
    address together carries only the outcome, and every later use shares that shuffle.
    """
    parsed = captures.withColumn("_x", F.from_xml("body", _SITEMAP_SCHEMA, _SITEMAP_OPTIONS))
    root = F.regexp_extract("body", _PROLOG, 1)
    well_formed = F.col("_x").isNotNull() & F.col("_x._malformed").isNull() & (root != "")
    answered = F.coalesce(F.col("status_code") == 200, F.lit(False))
    outcome = F.struct(
        (answered & F.coalesce(well_formed, F.lit(False))).alias("_usable"), answered.alias("_answered"), _fetched_at(captures).alias("_at"),
        "status_code", "content_type",
        F.coalesce(well_formed, F.lit(False)).alias("ok"),
        root.endswith("sitemapindex").alias("is_index"),
        F.coalesce(F.size("_x.url"), F.lit(0)).alias("pages"),
        F.filter(F.col("_x.sitemap.loc"), lambda u: u.isNotNull()).alias("children"),
    )
    return parsed.groupBy("url").agg(F.max(outcome).alias("c")).select("url", "c.*").drop("_usable", "_answered", "_at")


def sitemap_page_counts(parsed: DataFrame) -> DataFrame:
    """Adds the pages behind each sitemap; an index sums the children that arrived whole."""
    children = (
        parsed.where(F.col("ok") & F.col("is_index"))
        .select(F.col("url").alias("_index"), F.explode("children").alias("_child"))
        .join(
            parsed.where((F.col("status_code") == 200) & F.col("ok")).select(F.col("url").alias("_child"), "pages"),
            "_child",
        )
        .groupBy("_index").agg(F.sum("pages").alias("_sum"))
    )
    total = F.when(F.col("is_index"), F.coalesce("_sum", F.lit(0))).otherwise(F.col("pages"))
    return (
        parsed.join(children, F.col("url") == F.col("_index"), "left")
        .select("url", "status_code", "content_type", "ok", "is_index", total.cast("int").alias("total_pages"))
    )


def check_sitemaps(domains: DataFrame, captures: DataFrame) -> DataFrame:
    """First usable sitemap of each domain and its page count.

    ``domains`` holds each domain once. A candidate is looked at when it answered 200 with an
    XML type. The best-placed well-formed one decides; if all are malformed, the last of them
    is still reported as found, with no pages.
    """
    paths = F.array(*[F.lit(p) for p in SITEMAP_PATHS])
    tried = domains.select("domain", F.posexplode(paths).alias("rank", "_path")).select(
        "domain", "rank", F.concat(F.lit("https://"), "domain", F.lit("/"), "_path").alias("url")
    )
    counted = tried.join(sitemap_page_counts(parse_sitemaps(captures)), "url").where(
        (F.col("status_code") == 200) & F.coalesce(F.col("content_type").contains("xml"), F.lit(False))
    )
    best = F.min(F.when(F.col("ok"), F.struct("rank", "url", "total_pages")))
    last = F.max(F.when(~F.col("ok"), F.struct("rank", "url")))
    found = counted.groupBy("domain").agg(best.alias("_best"), last.alias("_last"))
    return domains.join(found, "domain", "left").select(
        "domain",
        F.coalesce("_best.url", "_last.url").alias("sitemap_found"),
        F.coalesce("_best.total_pages", F.lit(0)).alias("total_pages"),
    )


_OPTIONAL_LOG = {"fetched_at": "timestamp", "error_text": "string", "performance_timing": "string"}


def _reply(wanted: Column) -> Column:
    """The reply that counts among the wanted log rows: a successful one before others, then the latest."""
    row = F.struct(
        F.coalesce(F.col("status_code").between(200, 399), F.lit(False)).alias("success"), "fetched_at", "status_code", "final_url",
        "error_kind", F.coalesce("error_text", "error_kind").alias("error"), "last_modified", "load_seconds", "performance_timing",
    )
    return F.max(F.when(wanted, row))


def fetch_summary(log: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per page from its few log rows; combined map-side before the shuffle.

    ``last_modified`` is what the HEAD reply says. Log columns fetched_at, error_text and performance_timing may be absent.
    """
    log = log.withColumns({n: F.lit(None).cast(t) for n, t in _OPTIONAL_LOG.items() if n not in log.columns})
    kind = lambda scheme, method: (F.col("scheme") == scheme) & (F.col("method") == method)
    replies = log.groupBy(key).agg(
        _reply(kind("http", "GET")).alias("http"), _reply(kind("https", "HEAD")).alias("head"), _reply(kind("https", "GET")).alias("get"),
        _reply(F.col("method") == "HEAD").alias("_any_head"), _reply(F.col("method") == "LOAD").alias("_load"),
    )
    return replies.select(
        key, "http", "head", "get", F.col("_any_head.last_modified").alias("last_modified"),
        F.col("_load.load_seconds").alias("load_seconds"), F.col("_load.performance_timing").alias("performance_timing"),
    )


def http_policy(domain: Column) -> Column:
    """Verdict on the columns of :func:`fetch_summary`.

    HEAD settles the certificate question unless it failed for another reason; then GET does.
    """
    status = F.col("http.status_code")
    allowed = F.coalesce(status.between(200, 399), F.lit(False))
    replied = {m: F.col(f"{m}.status_code").isNotNull() for m in ("head", "get")}
    secure = F.when(replied["head"], F.col("head.status_code")).when(~F.coalesce(F.col("head.error_kind") == "ssl", F.lit(False)), F.col("get.status_code"))
    bad = {m: F.coalesce(F.col(f"{m}.error_kind") == "ssl", F.lit(False)) for m in ("head", "get")}
    return F.struct(
        domain.alias("domain"),
        allowed.alias("http_allowed"),
        F.when(allowed, F.coalesce(F.col("http.final_url"), F.lit("")).startswith("https://")).alias("redirects_to_https"),
        F.when(replied["head"], False).when(bad["head"], True)
        .when(replied["get"], False).when(bad["get"], True).alias("ssl_bad"),
        F.when(~allowed, status).alias("status_code"),
        F.when(status.isNull(), F.coalesce(F.col("http.error"), F.lit("Invalid response object"))).alias("error"),
        F.when(~secure.between(200, 399), secure).alias("https_status_code"),
        F.when(~replied["head"] & bad["head"], F.col("head.error"))
        .when(~replied["head"] & ~replied["get"] & bad["get"], F.col("get.error")).alias("ssl_error"),
        F.when(~replied["head"] & ~bad["head"] & ~replied["get"] & ~bad["get"], F.col("get.error")).alias("https_error"),
    )


def load_time(url: Column) -> Column:
    return F.struct(
        url.alias("url"), F.col("load_seconds").alias("load_time_seconds"),
        F.col("performance_timing"),
    )


def domains_of(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.select(site_urls(F.col(url))["domain"].alias("domain")).where(F.col("domain").isNotNull()).distinct()
