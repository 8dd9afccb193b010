"""Site signal queries over the given pages, with features added by page number."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectry.catalog import standins as st
from prospectry.catalog.registry import query
from prospectry.functions.urls import site_urls
from prospectry.operators import captures, profile, site
from prospectry.plans.profiling import profile_and_score
from prospectry.session import materialize

_ROWS = f"WITH p AS ({st.SITE_PAGES_SQL})"
def _page() -> F.Column:
    return F.col("page")


_COUNT = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+'))"
_WORDS = f"CAST({_COUNT.format(st.TEXT_SQL)} AS INT)"


def _features(spark, d):
    return site.page_features(st.site_pages(spark, d))


@query(
    "page_features",
    f"""{_ROWS} SELECT page_id, CAST(len(regexp_extract_all(html, '<h1>')) AS INT) AS h1_count, CAST(len(regexp_extract_all(html, '<img ')) AS INT) AS img_count,
        CAST(len(regexp_extract_all(html, '(?i)<meta ')) AS INT) AS metas,
        CAST(len(regexp_extract_all(html, '(?i)<script[ >]')) AS INT) AS scripts,
        CAST(len(regexp_extract_all(html, '(?i)<style>')) AS INT) AS styles,
        CAST(CASE WHEN page_id % 7 IN (1, 2) THEN 1 ELSE 0 END AS INT) AS stylesheets FROM p""",
)
def page_features(spark, d):
    size = lambda n: F.size(f"page.{n}").alias(n)
    return _features(spark, d).select(
        "page_id", "page.h1_count", "page.img_count", size("metas"), size("scripts"), size("styles"), size("stylesheets")
    )


@query("count_words", f"{_ROWS} SELECT page_id, {_WORDS} AS words FROM p")
def count_words(spark, d):
    return _features(spark, d).select("page_id", site.words(_page()).alias("words"))


@query("count_images", f"{_ROWS} SELECT page_id, CAST(len(regexp_extract_all(html, '<img ')) AS INT) AS images FROM p")
def count_images(spark, d):
    return _features(spark, d).select("page_id", F.col("page.img_count").alias("images"))


@query(
    "uses_js",
    f"""{_ROWS}, a AS (SELECT page_id, {_WORDS} AS n FROM p), b AS (SELECT page_id, {_WORDS} AS n FROM pages)
    SELECT a.page_id, a.n > b.n AS "usesJs" FROM a JOIN b ON a.page_id = b.page_id""",
)
def uses_js(spark, d):
    return site.uses_js(st.site_pages(spark, d), st.raw_pages(spark, d))


_TITLE = "replace(replace(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '&quot;', '\"'), '&amp;', '&')"


@query("generic_title", f"{_ROWS} SELECT page_id, {_TITLE} AS title, page_id % 12 = 0 AS is_generic FROM p")
def generic_title(spark, d):
    titled = _features(spark, d).select("page_id", site.generic_title(_page()).alias("t"))
    return titled.select("page_id", "t.*")


@query("has_h1", f"{_ROWS} SELECT page_id, html LIKE '%<h1>%' AS h1 FROM p")
def has_h1(spark, d):
    return _features(spark, d).select("page_id", site.has_h1(_page()).alias("h1"))


@query("has_meta_description", "SELECT page_id, page_id % 3 = 0 AS described FROM pages")
def has_meta_description(spark, d):
    return _features(spark, d).select("page_id", site.has_meta_description(_page()).alias("described"))


@query("has_favicon", "SELECT page_id, page_id % 4 = 0 AS favicon FROM pages")
def has_favicon(spark, d):
    return st.site_pages(spark, d).select("page_id", site.has_favicon(F.col("html")).alias("favicon"))


@query("is_html5", f"{_ROWS} SELECT page_id, lower(ltrim(html)) LIKE '<!doctype html>%' AS html5 FROM p")
def is_html5(spark, d):
    return st.site_pages(spark, d).select("page_id", site.is_html5(F.col("html")).alias("html5"))


@query("has_analytics", "SELECT page_id, page_id % 5 IN (0, 1) AS analytics FROM pages")
def has_analytics(spark, d):
    return _features(spark, d).select("page_id", site.has_analytics(_page()).alias("analytics"))


def _browser(name: str) -> F.Column:
    """Globals captured in the browser, on some pages only."""
    return F.expr("CASE WHEN page_id % 11 = 0 THEN map('Vue', true, '$', page_id % 2 = 0, 'Ember', false) END")


@query("detect_jquery", "SELECT page_id, page_id % 6 = 0 OR page_id % 22 = 0 AS jquery FROM pages")
def detect_jquery(spark, d):
    return _features(spark, d).select("page_id", site.detect_jquery(_page(), _browser("$")).alias("jquery"))


_FRAMEWORKS = """concat_ws(',', CASE WHEN page_id % 9 = 0 THEN 'Next.js' WHEN page_id % 9 = 1 THEN 'React' END,
    CASE WHEN page_id % 9 = 1 THEN 'Nuxt.js' WHEN page_id % 11 = 0 THEN 'Vue' END,
    CASE WHEN page_id % 9 = 2 THEN 'Angular,Svelte' WHEN page_id % 9 = 3 THEN 'Alpine.js,Astro,Stimulus.js,Lit / LitElement' END)"""


@query("detect_frameworks", f"SELECT page_id, coalesce(nullif({_FRAMEWORKS}, ''), 'Unknown') AS frameworks FROM pages")
def detect_frameworks(spark, d):
    found = site.frameworks_of(F.col("marks"), _page(), _browser("Vue"))
    marked = st.site_pages(spark, d).withColumn("marks", site.framework_marks(F.col("html")))
    return site.page_features(marked).select("page_id", F.array_join(found, ",").alias("frameworks"))


_BUILDERS = "CASE page_id % 8 WHEN 0 THEN 'WordPress' WHEN 1 THEN 'Wix,Squarespace' WHEN 2 THEN 'Drupal' ELSE 'Unknown' END"


@query("detect_site_builder", f"SELECT page_id, {_BUILDERS} AS builders FROM pages")
def detect_site_builder(spark, d):
    return st.site_pages(spark, d).select("page_id", F.array_join(site.site_builders(F.col("html")), ",").alias("builders"))


@query(
    "match_patterns",
    f"WITH b AS (SELECT page_id, unnest(string_split({_BUILDERS}, ',')) AS builder FROM pages) SELECT builder, count(*) AS pages FROM b GROUP BY builder",
)
def match_patterns(spark, d):
    found = st.site_pages(spark, d).select(F.explode(site.site_builders(F.col("html"))).alias("builder"))
    return found.groupBy("builder").agg(F.count("*").alias("pages"))


# Style sheets 0 and 1 of each set have a media rule and arrived; 4 has one but was refused.
_SHEET = f"""CASE page_id % 7 WHEN 1 THEN concat('http://', {st.DOMAIN}, '/css/m', CAST(page_id % 10 AS STRING), '.css')
    WHEN 2 THEN concat('https://cdn.example.com/m', CAST(page_id % 10 AS STRING), '.css') END"""
_GOOD_SHEETS = f"SELECT css_url FROM ({st.as_sql('pages', {**st.CSS, 'page_id': 'page_id'})}) WHERE page_id % 10 IN (0, 1)"
_RESPONSIVE = f"page_id % 2 = 0 AND (page_id % 7 = 0 OR coalesce({_SHEET} IN ({_GOOD_SHEETS}), false))"


@query("page_stylesheets", f"SELECT page_id, {_SHEET} AS css_url FROM pages WHERE page_id % 7 IN (1, 2)")
def page_stylesheets(spark, d):
    pages = _features(spark, d).select("page_id", "url", "page.stylesheets")
    return site.page_stylesheets(pages, site.base_url(F.col("url")))


@query("is_responsive", f"SELECT page_id, {_RESPONSIVE} AS responsive FROM pages")
def is_responsive(spark, d):
    signals = _features(spark, d).select("page_id", "url", *[c.alias(n) for n, c in site.layout_signals().items()])
    return site.is_responsive(materialize(signals, "layout"), st.css_capture(spark, d), site.base_url(F.col("url")))


_YEAR = f"list_max(list_transform(regexp_extract_all({st.FULL_TEXT_SQL}, '20[1-3][0-9]'), lambda y: CAST(y AS INT)))"


@query(
    "last_update",
    f"""{_ROWS} SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Tue, 01 Feb 2022 00:00:00 GMT' ELSE NULL END AS last_modified_header,
        CASE page_id % 10 WHEN 0 THEN '2021-05-06' WHEN 1 THEN '2019-01-02' ELSE NULL END AS meta_date,
        CAST({_YEAR} AS INT) AS latest_year_in_text, html LIKE '%<p>Updated on%' AS has_updated_phrase FROM p""",
)
def last_update(spark, d):
    fetched = captures.fetch_summary(st.fetch_log(spark, d)).select("page_id", "last_modified")
    joined = _features(spark, d).join(fetched, "page_id", "left")
    return joined.select("page_id", site.last_update(_page(), F.col("last_modified")).alias("u")).select("page_id", "u.*")


# --- captured responses --------------------------------------------------------------------


@query("check_sitemap", st.SITEMAP_RESULT_SQL)
def check_sitemap(spark, d):
    return captures.check_sitemaps(captures.domains_of(st.raw_pages(spark, d)), st.sitemap_capture(spark, d))


@query("first_sitemap", f"SELECT domain, sitemap_found FROM ({st.SITEMAP_RESULT_SQL}) WHERE sitemap_found IS NOT NULL")
def first_sitemap(spark, d):
    found = captures.check_sitemaps(captures.domains_of(st.raw_pages(spark, d)), st.sitemap_capture(spark, d))
    return found.where(F.col("sitemap_found").isNotNull()).select("domain", "sitemap_found")


_LENGTH = f"length({st.DOMAIN})"


@query(
    "sitemap_page_count",
    f"""SELECT DISTINCT concat('https://', {st.DOMAIN}, '/', path) AS url, is_index, CAST(pages AS INT) AS total_pages FROM pages,
        LATERAL (VALUES ('sitemap.xml', 0, false, {_LENGTH} % 7), ('sitemap_index.xml', 1, true, 2 + {_LENGTH} % 7), ('a.xml', 1, false, 2 + {_LENGTH} % 7),
            ('sitemap.xml', 1, false, 0), ('sitemap-index.xml', 3, false, 2), ('sitemap.xml', 5, false, 0)) AS m(path, kind, is_index, pages) WHERE {_LENGTH} % 6 = kind""",
)
def sitemap_page_count(spark, d):
    counted = captures.sitemap_page_counts(captures.parse_sitemaps(st.sitemap_capture(spark, d)))
    return counted.where("ok").select("url", "is_index", "total_pages")


@query(
    "sitemap_children",
    f"""SELECT DISTINCT concat('https://', {st.DOMAIN}, '/sitemap_index.xml') AS url, concat('https://', {st.DOMAIN}, '/', c) AS child
    FROM pages, (VALUES ('a.xml'), ('b.xml'), ('c.xml')) AS v(c) WHERE {_LENGTH} % 6 = 1""",
)
def sitemap_children(spark, d):
    parsed = captures.parse_sitemaps(st.sitemap_capture(spark, d))
    return parsed.where("ok AND is_index").select("url", F.explode("children").alias("child"))


_HTTP_STATUS = "CASE WHEN page_id % 7 = 3 OR page_id % 7 = 2 THEN NULL WHEN page_id % 7 = 1 THEN 404 WHEN page_id % 7 = 4 THEN 301 ELSE 200 END"
_POLICY = {
    "domain": st.DOMAIN,
    "http_allowed": "page_id % 7 IN (0, 4, 5, 6)",
    "redirects_to_https": "CASE WHEN page_id % 7 IN (0, 4, 5, 6) THEN page_id % 2 = 0 ELSE NULL END",
    "ssl_bad": "CASE WHEN page_id % 5 < 2 THEN false WHEN page_id % 5 = 2 THEN true WHEN page_id % 5 = 3 THEN page_id % 2 <> 0 ELSE NULL END",
    "status_code": "CASE WHEN page_id % 7 = 1 THEN 404 ELSE NULL END",
    "error": "CASE page_id % 7 WHEN 2 THEN 'other' WHEN 3 THEN 'Invalid response object' ELSE NULL END",
    "https_status_code": "CASE WHEN page_id % 5 = 1 THEN 503 ELSE NULL END",
    "ssl_error": "CASE WHEN page_id % 5 = 2 OR page_id % 5 = 3 AND page_id % 2 <> 0 THEN 'ssl' ELSE NULL END",
    "https_error": "CASE WHEN page_id % 5 = 4 THEN 'other' ELSE NULL END",
}


@query("http_policy", f"SELECT page_id, {', '.join(f'{e} AS {n}' for n, e in _POLICY.items())} FROM pages")
def http_policy(spark, d):
    pages = st.raw_pages(spark, d).select("page_id", site_urls(F.col("url"))["domain"].alias("domain"))
    joined = pages.join(captures.fetch_summary(st.fetch_log(spark, d)), "page_id", "left")
    return joined.select("page_id", captures.http_policy(F.col("domain")).alias("h")).select("page_id", "h.*")


@query("load_time", "SELECT page_id, url, CASE WHEN page_id % 11 <> 5 THEN CAST(page_id % 90 AS DOUBLE) / 8 ELSE NULL END AS load_time_seconds, CASE WHEN page_id % 11 <> 5 THEN concat('start ', CAST(page_id AS STRING)) ELSE NULL END AS performance_timing FROM pages")
def load_time(spark, d):
    joined = st.raw_pages(spark, d).select("page_id", "url").join(captures.fetch_summary(st.fetch_log(spark, d)), "page_id", "left")
    return joined.select("page_id", captures.load_time(F.col("url")).alias("s")).select("page_id", "s.*")


# --- the whole profile ---------------------------------------------------------------------

_OWN = {
    "phone": "CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '+1 555' ELSE '555' END",
    "address": "CASE WHEN page_id % 5 = 0 THEN '' ELSE 'Main St' END",
    "website": "CASE WHEN page_id % 17 = 0 THEN NULL ELSE url END",
    "gbp_is_verified": "CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END",
    "gbp_has_image": "page_id % 2 = 0",
    "attributes": "CASE WHEN page_id % 6 = 0 THEN NULL ELSE CAST(page_id % 9 AS INT) END",
    "n": "CAST(page_id % 3 AS INT)",
}


def _own_listings(spark, d):
    rows = st.derive(spark, d, "pages", {"page_id": "page_id", **_OWN})
    return rows.withColumn("categories", F.expr("slice(array('a', 'b'), 1, n)")).drop("n")


def _profile(spark, d):
    signals = materialize(profile.page_signals(st.site_pages(spark, d)), "signals")
    return profile.site_profile(
        _own_listings(spark, d), signals, st.raw_pages(spark, d), st.fetch_log(spark, d),
        st.css_capture(spark, d), st.sitemap_capture(spark, d),
    )


_STATIC_FRAMEWORKS = _FRAMEWORKS.replace("WHEN page_id % 11 = 0 THEN 'Vue' ", "")
PROFILE = {
    "http_allowed": _POLICY["http_allowed"], "redirects_to_https": _POLICY["redirects_to_https"], "ssl_bad": _POLICY["ssl_bad"],
    "framework": f"coalesce(nullif({_STATIC_FRAMEWORKS}, ''), 'Unknown')",
    "title": _TITLE, "is_generic": "page_id % 12 = 0",
    "load_seconds": "CASE WHEN page_id % 11 <> 5 THEN CAST(page_id % 90 AS DOUBLE) / 8 ELSE NULL END",
    "latest_year": f"CAST({_YEAR} AS INT)", "images": "CAST(len(regexp_extract_all(html, '<img ')) AS INT)", "words": _WORDS, "uses_js": f"{_WORDS} > raw_words",
    "domain": st.DOMAIN, "builders": _BUILDERS, "jquery": "page_id % 6 = 0", "analytics": "page_id % 5 IN (0, 1)",
    "described": "page_id % 3 = 0", "h1": "html LIKE '%<h1>%'", "favicon": "page_id % 4 = 0",
    "phone_plus": "page_id % 4 = 1", "has_phone": "page_id % 4 <> 0", "has_address": "page_id % 5 <> 0",
    "verified": "page_id % 3 = 1", "n_categories": "CAST(page_id % 3 AS INT)", "has_image": "page_id % 2 = 0",
    "attributes": "CASE WHEN page_id % 6 = 0 THEN -1 ELSE CAST(page_id % 9 AS INT) END", "has_website": "page_id % 17 <> 0",
}
_PROFILE_FROM = f"""{_ROWS}, r AS (SELECT page_id, {_WORDS} AS raw_words FROM pages), m AS ({st.SITEMAP_RESULT_SQL}),
    g AS (SELECT page_id AS gid, {_RESPONSIVE} AS responsive FROM pages),
    f AS (SELECT p.page_id, {', '.join(f'{e} AS {n}' for n, e in PROFILE.items())}
        FROM (SELECT p.*, r.raw_words FROM p JOIN r ON p.page_id = r.page_id) AS p)"""
PROFILE_SQL = f"""{_PROFILE_FROM} SELECT f.*, g.responsive, m.sitemap_found, m.total_pages, true AS html5
    FROM f JOIN g ON f.page_id = g.gid LEFT JOIN m ON f.domain = m.domain"""


@query("site_profile", PROFILE_SQL)
def site_profile(spark, d):
    return _profile(spark, d).select(
        "page_id", "isHttpAllowed.http_allowed", "isHttpAllowed.redirects_to_https", "isHttpAllowed.ssl_bad",
        F.array_join("framework", ",").alias("framework"), "genericTitle.title", "genericTitle.is_generic",
        F.col("speedMetrics.load_time_seconds").alias("load_seconds"), F.col("lastUpdate.latest_year_in_text").alias("latest_year"),
        "images", "words", F.col("usesJs").alias("uses_js"), "domain", F.array_join("siteBuilder.builders_detected", ",").alias("builders"),
        "jquery", "analytics", F.col("metaDescription").alias("described"), "h1", "favicon",
        F.col("phoneStartsWithPlus").alias("phone_plus"), F.col("hasPhone").alias("has_phone"), F.col("hasAddress").alias("has_address"),
        F.col("gbp_is_verified").alias("verified"), "n_categories", F.col("gbp_has_image").alias("has_image"), "attributes", "has_website",
        "responsive", "sitemap.sitemap_found", "sitemap.total_pages", "html5",
    )


def scored_profile(spark, d):
    return profile_and_score(
        _own_listings(spark, d), st.site_pages(spark, d), st.raw_pages(spark, d), st.fetch_log(spark, d),
        st.css_capture(spark, d), st.sitemap_capture(spark, d), as_of_year=2026,
    )
