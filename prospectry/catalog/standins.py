"""Listing, search, verdict and page tables derived from the driver tables.

Each column is one SQL expression that Spark and the checking engine both read, so both sides
start from the same values. Every table is as long as the one it is derived from, or longer by
a fixed factor. Only the rows that pages are made of are shuffled, while they are still narrow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from prospectry.functions.lists import parse_categories

# Result lists, in input order.
MAP_FILES = [f"maps_{f}{s}.parquet" for f in "ANR" for s in "FO"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a narrow table that one task makes pages of.
PAGE_ROWS = 2000


def spread(rows: DataFrame) -> DataFrame:
    """The same rows over enough tasks for what is made of them: a file of a few MB would be one task, whatever comes of its rows."""
    return rows.repartition(max(1, -(-rows.count() // PAGE_ROWS)))


def derive(spark: SparkSession, sf_dir: str, source: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def as_sql(source: str, columns: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


# --- listings: one row per appearance, from lineitem ---------------------------------------

_LINK = "concat('https://maps.example.com/place/', CAST(l_partkey AS STRING))"

LISTINGS = {
    "listing_link": f"""CASE WHEN l_suppkey % 50 = 7 THEN NULL WHEN l_suppkey % 50 = 8 THEN '   '
        WHEN l_suppkey % 50 = 9 THEN concat({_LINK}, ' ') ELSE {_LINK} END""",
    "map_file": "concat('maps_', l_returnflag, l_linestatus, '.parquet')",
    "file_idx": """CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 1 WHEN 'AO' THEN 2
        WHEN 'NF' THEN 3 WHEN 'NO' THEN 4 WHEN 'RF' THEN 5 ELSE 6 END""",
    "position": "CASE l_linenumber WHEN 7 THEN NULL WHEN 6 THEN '6.0' ELSE CAST(l_linenumber AS STRING) END",
    "name": """CASE l_linenumber % 3 WHEN 2 THEN '  ' WHEN 1 THEN NULL
        ELSE concat('Business ', CAST(l_partkey AS STRING), ' in ', l_returnflag) END""",
    "categories": """CASE l_linenumber WHEN 1 THEN NULL
        WHEN 2 THEN concat('["Type ', CAST(l_suppkey % 5 AS STRING), '", "Brand ', CAST(l_partkey % 25 AS STRING), '"]')
        WHEN 3 THEN concat('[''Type ', CAST(l_suppkey % 5 AS STRING), ''', ''Brand ', CAST(l_partkey % 25 AS STRING), ''', ''type ', CAST(l_suppkey % 5 AS STRING), ''']')
        WHEN 4 THEN concat('Type ', CAST(l_suppkey % 5 AS STRING), '|Brand ', CAST(l_partkey % 25 AS STRING), '|TYPE ', CAST(l_suppkey % 5 AS STRING))
        WHEN 5 THEN concat('Type ', CAST(l_suppkey % 5 AS STRING), ', Brand ', CAST(l_partkey % 25 AS STRING))
        WHEN 6 THEN '  ' ELSE concat('{"type": ', CAST(l_suppkey % 5 AS STRING), '}') END""",
    "website": """CASE WHEN l_suppkey % 4 = 0 THEN NULL
        ELSE concat('https://www.site', CAST(l_suppkey AS STRING), '.example.com/') END""",
    "phone": """CASE l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ''
        ELSE concat('+1 555 ', CAST(l_suppkey AS STRING)) END""",
    "address": """CASE WHEN l_linenumber IN (1, 4) THEN NULL
        ELSE concat(CAST(l_suppkey AS STRING), ' Main St') END""",
    "reviews_count": "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(floor(l_extendedprice) AS INT) % 500 END",
    "rating": "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(25 + CAST(l_quantity AS INT) % 26 AS DOUBLE) / 10 END",
    "status": "CASE l_linestatus WHEN 'O' THEN 'Open until 5 PM' ELSE 'Closed' END",
    "source_file": "concat('queries_', CAST(l_orderkey % 3 AS STRING), '.parquet')",
    "search_volume": "CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE CAST(l_orderkey % 1000 AS DOUBLE) END",
    "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_suppkey": "l_suppkey",
    "l_partkey": "l_partkey", "l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice",
}

# Order of appearances: list first, then row. These columns fix every value of a row.
ORDER = ["file_idx", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]
LISTINGS_SQL = as_sql("lineitem", LISTINGS)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result-list rows; categories still text."""
    return derive(spark, sf_dir, "lineitem", LISTINGS).withColumn("ord", F.struct(*ORDER))


def parsed_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).withColumn("categories", parse_categories(F.col("categories")))


# --- searches: one row per query, from orders ----------------------------------------------

_C = "CAST(o_custkey AS STRING)"

SEARCHES = {
    "page_id": "o_orderkey",
    "ord": "o_orderkey",
    "source_file": "concat('queries_', CAST(o_orderkey % 5 AS STRING), '.parquet')",
    "query_url": f"""CASE o_orderkey % 6
        WHEN 0 THEN concat('https://maps.example.com/maps?q=Roof%20Repair+', {_C})
        WHEN 1 THEN concat('https://maps.example.com/maps?hl=en&query=Spray+Foam,', {_C}, '#top')
        WHEN 2 THEN concat('https://maps.example.com/maps/search/attic+insulation/@39.', {_C}, ',-105.05,11z')
        WHEN 3 THEN concat('https://maps.example.com/maps/search/50%+Off+', {_C}, '?hl=en')
        WHEN 4 THEN CASE WHEN o_orderkey % 30 = 4 THEN '  ' WHEN o_orderkey % 30 = 10 THEN NULL
            ELSE 'https://maps.example.com/maps?q=%20&query=x' END
        ELSE concat('https://maps.example.com/maps?q=&q=a%252Fb|', {_C}) END""",
    "status": "CASE o_orderstatus WHEN 'O' THEN ' Success ' WHEN 'F' THEN 'error' ELSE NULL END",
    "search_volume": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 1000 AS DOUBLE) END",
}
SEARCHES_SQL = as_sql("orders", SEARCHES)

# What the slug of each search must be, stated from the parts it was built of.
SEARCH_SLUG_SQL = f"""CASE o_orderkey % 6
    WHEN 0 THEN concat('roof_repair_', {_C})
    WHEN 1 THEN concat('spray_foam_', {_C})
    WHEN 2 THEN concat('attic_insulation_@39_', {_C}, '_-105_05_11z')
    WHEN 3 THEN concat('50%_off_', {_C})
    WHEN 4 THEN CASE WHEN o_orderkey % 30 IN (4, 10) THEN 'google maps query' ELSE 'maps' END
    ELSE concat('a_b_', {_C}) END"""


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "orders", SEARCHES)


# --- verdicts from events, merged rows they refer to from customer --------------------------

VERDICTS = {
    "seq": "event_id",
    "file_idx": "CAST(user_id % 3 AS INT)",
    "row_idx": "user_id",
    "listing_link": """CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'https://maps.example.com/place/none'
        WHEN 2 THEN concat(' https://maps.example.com/place/', CAST(user_id AS STRING), ' ')
        ELSE concat('https://maps.example.com/place/', CAST(user_id AS STRING)) END""",
    "eval_rating": "CASE event_type WHEN 'purchase' THEN 'good' WHEN 'error' THEN 'bad' WHEN 'click' THEN 'Okay ' ELSE '' END",
    "eval_time": "ts",
    "notes": "props",
}
VERDICTS_SQL = as_sql("events", VERDICTS)

PARENT = {
    "file_idx": "CAST(c_custkey % 3 AS INT)",
    "row_idx": "c_custkey",
    "listing_link": """CASE WHEN c_custkey % 11 = 0 THEN NULL
        WHEN c_custkey % 11 = 1 THEN concat('https://maps.example.com/place/', CAST(c_custkey AS STRING), '  ')
        ELSE concat('https://maps.example.com/place/', CAST(c_custkey AS STRING)) END""",
    "name": "c_name",
    "status": "CASE WHEN c_acctbal < 0 THEN ' Bad' WHEN c_acctbal > 9000 THEN 'GOOD' ELSE 'pending' END",
}
PARENT_SQL = as_sql("customer", PARENT)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "events", VERDICTS)


def merged_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "customer", PARENT)


# --- site pages: the given pages with features added by page number -------------------------

_HEAD = """concat(
    CASE WHEN page_id % 2 = 0 THEN '<meta name="viewport" content="width=device-width">' ELSE '' END,
    CASE page_id % 3 WHEN 0 THEN '<meta name="description" content="About us">'
        WHEN 1 THEN '<meta content="  " name="description">' ELSE '' END,
    CASE WHEN page_id % 4 = 0 THEN '<link rel="icon" href="/i.png">' ELSE '' END,
    CASE page_id % 5 WHEN 0 THEN '<script async src="https://www.googletagmanager.com/gtm.js?id=1"></script>'
        WHEN 1 THEN '<script>gtag("js")</script>' ELSE '' END,
    CASE WHEN page_id % 6 = 0 THEN '<script src="/js/jQuery.min.js"></script>' ELSE '' END,
    CASE page_id % 7 WHEN 0 THEN '<style>@media (max-width:9px){p{margin:0}}</style>'
        WHEN 1 THEN concat('<link rel="stylesheet" href="/css/m', CAST(page_id % 10 AS STRING), '.css">')
        WHEN 2 THEN concat('<LINK rel="preload stylesheet" href="https://cdn.example.com/m', CAST(page_id % 10 AS STRING), '.css">')
        WHEN 3 THEN '<style>/* @media x{} */ @supports (a) { @media (b) { p{margin:0} } }</style>' ELSE '' END,
    CASE page_id % 8 WHEN 0 THEN '<script src="/wp-content/a.js"></script>'
        WHEN 1 THEN '<!-- static.WixStatic.com squarespace-cdn.com -->'
        WHEN 2 THEN '<script>var drupalSettings = 1</script>' ELSE '' END,
    CASE page_id % 9 WHEN 0 THEN '<meta name="next-head"><meta name="x" content="data-reactroot">'
        WHEN 1 THEN '<meta name="x" content="__reactInternalInstance _nuxt/ data-v-">'
        WHEN 2 THEN '<meta name="x" ng-version="1"><script>svelte-h</script>'
        WHEN 3 THEN '<meta name="x" content="x-data _astro/ data-controller lit-element">' ELSE '' END,
    CASE page_id % 10 WHEN 0 THEN '<meta property="article:modified_time" content="2021-05-06"><meta name="last-modified" content="2020">'
        WHEN 1 THEN '<meta name="last-modified" content="2019-01-02">' ELSE '' END,
    '</head>')"""

_BODY = """concat(
    repeat('<img src="a.png" alt="two words"/>', CAST(page_id % 4 AS INT)),
    CASE WHEN page_id % 10 < 3 THEN '<noscript>three more words</noscript>' ELSE '' END,
    CASE WHEN page_id % 10 = 2 THEN '<p>Updated on <b>March</b> 2021</p>' ELSE '' END,
    CASE WHEN page_id % 10 = 3 THEN '<p>built 2014, order 20391, 1999</p>' ELSE '' END,
    '</body>')"""

SITE_HTML = f"""replace(replace(replace(replace(replace(html,
    '</head>', {_HEAD}),
    '</body>', {_BODY}),
    '<!DOCTYPE html>', CASE page_id % 13 WHEN 0 THEN '' WHEN 1 THEN '  <!doctype HTML>' ELSE '<!DOCTYPE html>' END),
    '<h1>', CASE WHEN page_id % 14 = 0 THEN '<h2>' ELSE '<h1>' END),
    '<title>', CASE WHEN page_id % 12 = 0 THEN '<title> Home </title><title>' ELSE '<title>' END)"""

SITE_PAGES = {"page_id": "page_id", "url": "url", "html": SITE_HTML}
SITE_PAGES_SQL = as_sql("pages", SITE_PAGES)

# Markup taken off with patterns, for checking what the page parser reads. The pages hold no
# comment end inside scripts and only entities that are not letters.
_BARE = "html"
for _pattern in ("(?s)<!--.*?-->", "(?is)<script.*?</script>", "(?is)<style.*?</style>"):
    _BARE = f"regexp_replace({_BARE}, '{_pattern}', ' ', 'g')"
FULL_TEXT_SQL = f"regexp_replace(regexp_replace({_BARE}, '(?s)<[^>]*>', ' ', 'g'), '&[a-z]+;', ' ', 'g')"
TEXT_SQL = FULL_TEXT_SQL.replace(
    _BARE, f"regexp_replace({_BARE}, '(?is)<noscript>.*?</noscript>', ' ', 'g')"
)


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "pages", SITE_PAGES)


# --- captured responses, from pages --------------------------------------------------------

# Domain of a page, for expressions both engines read.
DOMAIN = "split_part(url, '/', 3)"

_FETCHES = [
    ("http", "GET", "page_id % 7 <> 3", {
        "final_url": "CASE WHEN page_id % 2 = 0 THEN concat('https://', {d}, '/') ELSE concat('http://', {d}, '/') END",
        "status_code": "CASE page_id % 7 WHEN 1 THEN 404 WHEN 2 THEN NULL WHEN 4 THEN 301 ELSE 200 END",
        "error_kind": "CASE page_id % 7 WHEN 2 THEN 'other' ELSE NULL END",
    }),
    ("https", "HEAD", "true", {
        "final_url": "concat('https://', {d}, '/')",
        "status_code": "CASE page_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 503 ELSE NULL END",
        "error_kind": "CASE page_id % 5 WHEN 2 THEN 'ssl' WHEN 3 THEN 'other' WHEN 4 THEN 'other' ELSE NULL END",
        "last_modified": "CASE WHEN page_id % 3 = 0 THEN 'Tue, 01 Feb 2022 00:00:00 GMT' ELSE NULL END",
    }),
    ("https", "GET", "page_id % 5 > 2", {
        "final_url": "concat('https://', {d}, '/')",
        "status_code": "CASE WHEN page_id % 5 = 3 AND page_id % 2 = 0 THEN 200 ELSE NULL END",
        "error_kind": "CASE WHEN page_id % 5 = 3 AND page_id % 2 = 0 THEN NULL WHEN page_id % 5 = 3 THEN 'ssl' ELSE 'other' END",
    }),
    ("https", "LOAD", "page_id % 11 <> 5", {
        "final_url": "url", "status_code": "200", "error_kind": "CAST(NULL AS STRING)",
        "load_seconds": "CAST(page_id % 90 AS DOUBLE) / 8", "performance_timing": "concat('start ', CAST(page_id AS STRING))",
    }),
    # Failed or older repeats, which must not count, and a GET header that a HEAD reply goes before.
    ("http", "GET", "page_id % 7 IN (0, 4, 5, 6)", {"final_url": "'http://gone.example.com/'", "status_code": "500", "error_kind": "CAST(NULL AS STRING)", "day": "9"}),
    ("https", "HEAD", "page_id % 5 = 0", {"final_url": "url", "status_code": "503", "error_kind": "CAST(NULL AS STRING)", "day": "9"}),
    ("https", "LOAD", "page_id % 11 <> 5", {
        "final_url": "url", "status_code": "200", "error_kind": "CAST(NULL AS STRING)", "load_seconds": "99.5", "day": "1",
        "last_modified": "'Wed, 01 Jan 2020 00:00:00 GMT'",
    }),
]


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to seven replies per page, repeats among them, made by one explode."""
    rows = []
    for scheme, method, made, e in _FETCHES:
        e = {k: v.format(d=DOMAIN) for k, v in e.items()}
        rows.append(
            f"named_struct('made', {made}, 'scheme', '{scheme}', 'method', '{method}', 'requested_url', url, "
            f"'final_url', {e['final_url']}, 'status_code', CAST({e['status_code']} AS INT), "
            f"'error_kind', {e['error_kind']}, 'last_modified', {e.get('last_modified', 'CAST(NULL AS STRING)')}, "
            f"'load_seconds', CAST({e.get('load_seconds', 'NULL')} AS DOUBLE), 'fetched_at', timestamp'2026-01-0{e.get('day', 5)} 00:00:00', "
            f"'performance_timing', {e.get('performance_timing', 'CAST(NULL AS STRING)')})"
        )
    exploded = table(spark, sf_dir, "pages").selectExpr("page_id", f"inline(array({', '.join(rows)}))")
    return exploded.where("made").drop("made")


CSS = {
    "css_url": f"""CASE WHEN page_id % 2 = 0 THEN concat('http://', {DOMAIN}, '/css/m', CAST(page_id % 10 AS STRING), '.css')
        ELSE concat('https://cdn.example.com/m', CAST(page_id % 10 AS STRING), '.css') END""",
    "status_code": "CASE WHEN page_id % 10 = 4 THEN 404 ELSE 200 END",
    "body": """CASE WHEN page_id % 10 IN (0, 1, 4) THEN '/* "x */ p{color:red} @MEDIA print{p{margin:0}}'
        WHEN page_id % 10 = 2 THEN 'p{content:"@media x{}"} @mediafoo{}'
        WHEN page_id % 10 = 3 THEN '@import url(a);;@media x{p{}}' WHEN page_id % 10 = 5 THEN 'foo; @media x{p{}}'
        WHEN page_id % 10 = 6 THEN concat(repeat('@supports(a){x:y;', 8), '@media b{p{}}', repeat('}', 8)) ELSE 'p{margin:0}' END""",
}


def css_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "pages", CSS).withColumn("status_code", F.col("status_code").cast("int"))


# Six kinds of sites by length of the domain: plain map, index, none, broken then good, broken, refused.
_KIND = f"length({DOMAIN}) % 6"
_ENTRIES = f"repeat('<url><loc>x</loc></url>', CAST(length({DOMAIN}) % 7 AS INT))"
_SITEMAPS = [
    ("sitemap.xml", 0, 200, "text/xml", f"concat('<?xml version=\"1.0\"?><urlset xmlns=\"http://s.example.com/s\">', {_ENTRIES}, '</urlset>')"),
    ("sitemap.xml", 1, 200, "text/html", "'<html></html>'"),
    ("sitemap_index.xml", 1, 200, "application/xml", f"""concat('<!-- i --><sitemapindex><sitemap><loc>https://', {DOMAIN}, '/a.xml</loc></sitemap><sitemap><loc>https://', {DOMAIN}, '/b.xml</loc></sitemap><sitemap/><sitemap><loc>https://', {DOMAIN}, '/c.xml</loc></sitemap></sitemapindex>')"""),
    ("a.xml", 1, 200, "text/plain", f"concat('<urlset><url/><url/>', {_ENTRIES}, '</urlset>')"),
    ("b.xml", 1, 200, "text/xml", "'<urlset><url></urlset>'"),
    ("sitemap.xml", 3, 200, "text/xml", "'<urlset>'"),
    ("sitemap-index.xml", 3, 200, "text/xml", "'<urlset><url/><url/></urlset>'"),
    ("sitemap.xml", 4, 200, "text/xml", "'not xml'"),
    ("sitemap.xml", 5, 404, "text/xml", "'<urlset/>'"),
    # Repeats that failed, later than the good capture.
    ("sitemap.xml", 0, 503, "text/xml", "'busy'"),
    ("sitemap_index.xml", 1, 503, "text/html", "'<html></html>'"),
    ("a.xml", 1, 200, "text/plain", "'<urlset>'"),
]


def sitemap_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        f"named_struct('made', {_KIND} = {kind}, 'url', concat('https://', {DOMAIN}, '/{path}'), "
        f"'status_code', {code}, 'content_type', '{ctype}', 'body', {body})"
        for path, kind, code, ctype, body in _SITEMAPS
    ]
    exploded = table(spark, sf_dir, "pages").selectExpr(f"inline(array({', '.join(rows)}))")
    return exploded.where("made").drop("made")


# Outcome of those sitemaps per domain.
SITEMAP_RESULT_SQL = f"""SELECT DISTINCT {DOMAIN} AS domain,
    CASE {_KIND} WHEN 0 THEN concat('https://', {DOMAIN}, '/sitemap.xml')
        WHEN 1 THEN concat('https://', {DOMAIN}, '/sitemap_index.xml')
        WHEN 3 THEN concat('https://', {DOMAIN}, '/sitemap-index.xml')
        WHEN 4 THEN concat('https://', {DOMAIN}, '/sitemap.xml') ELSE NULL END AS sitemap_found,
    CAST(CASE {_KIND} WHEN 0 THEN length({DOMAIN}) % 7 WHEN 1 THEN 2 + length({DOMAIN}) % 7
        WHEN 3 THEN 2 ELSE 0 END AS INT) AS total_pages
    FROM pages"""

# --- results pages and panels, from part ---------------------------------------------------

# Containers on each page, 1 to 4; ``v`` numbers them over all pages.
_BOX = """concat('<div class="', CASE WHEN p_partkey % 5 = 0 THEN 'Nv2PK' ELSE 'x Nv2PK tH5CWc THOPZb' END, '">',
    '<a class="hfpxzc" aria-label="', CASE WHEN v % 3 = 0 THEN ' ' ELSE concat('Firm &amp; Co ', CAST(v AS STRING)) END,
    '" href="', CASE WHEN v % 7 = 0 THEN '/relative' ELSE concat('https://maps.example.com/place/', CAST(v AS STRING)) END, '"></a>',
    '<div class="qBF1Pd big">Shop <b>', p_name, '</b> ', CAST(v AS STRING), '</div>',
    CASE WHEN v % 4 = 0 THEN '' ELSE concat('<span class="ZkP5Je" aria-label="stars"><span class="MW4etd">',
        CAST(3 + v % 2 AS STRING), '.', CAST(v % 10 AS STRING), '</span><span class="UY7F9">(1,', CAST(100 + v % 900 AS STRING), ')</span></span>') END,
    CASE WHEN v % 5 = 0 THEN concat('<div class="category-list-display btn"><span>', p_type, ' · ', p_brand,
        '</span><a>GMB Cat.</a><a>', lower(p_type), ':</a><span>x</span></div>') ELSE '' END,
    '<div class="W4Efsd"><div class="W4Efsd"><span>', p_type, '</span><span> · </span><span>', CAST(v AS STRING), ' Main St</span></div>',
    CASE WHEN v % 2 = 1 THEN concat('<div class="W4Efsd"><span>Open</span> · <span>Closes 5 PM</span><span class="UsdlK">+1 555 ',
        CAST(v AS STRING), '</span></div>') ELSE '' END, '</div>',
    CASE v % 6 WHEN 0 THEN concat('<a aria-label="Visit our WEBSITE" href="https://www.site', CAST(v AS STRING), '.example.com/">go</a>')
        WHEN 1 THEN '<a data-value="Website" href="ftp://old.example.com">go</a>' WHEN 2 THEN '<a aria-label="website">broken</a>' ELSE '' END,
    '</div>')"""


def results_pages(spark: SparkSession, sf_dir: str, of: str = "p_partkey") -> DataFrame:
    """Pages of one to four containers. ``of`` numbers them; pages with equal numbers show the same businesses."""
    # A lambda binds ``v``, so the container text is built per rank without a shuffle.
    numbers = f"transform(sequence(1, CAST(1 + p_partkey % 4 AS INT)), i -> {of} * 10 + i)"
    containers = F.expr(f"transform({numbers}, v -> {_BOX})")
    return spread(table(spark, sf_dir, "part")).select(
        F.col("p_partkey").alias("page_id"),
        F.concat(F.lit("<html><body><div role=feed>"), F.array_join(containers, "<hr>"), F.lit("</div></body></html>")).alias("html"),
    )


# One row per container: page, rank and number.
def boxes_sql(of: str = "p_partkey") -> str:
    return f"""SELECT p_partkey AS page_id, CAST(i AS INT) AS position, {of} * 10 + i AS v, p_name, p_type, p_brand
    FROM part, unnest(range(1, 2 + p_partkey % 4)) AS t(i)"""


BOXES_SQL = boxes_sql()

PANEL = """concat('<table><tr><td colspan="2"><strong> Firm ', CAST(v AS STRING), ' </strong><small>',
    CASE v % 3 WHEN 0 THEN 'Not Verified' WHEN 1 THEN 'Verified' ELSE '' END, '</small></td></tr>',
    '<tr><td>Categories<br>(<strong>2</strong>)</td><td>', CASE WHEN v % 4 = 1 THEN ' , ' ELSE 'Roofer, ,Painter' END, '</td></tr>',
    '<tr><td>Place ID</td><td data-pid="x">ChIJ', CAST(v AS STRING), '</td></tr><tr><td>CID</td><td>', CAST(v * 1000003 AS STRING), '</td></tr>',
    '<tr><td>Business Profile ID</td><td>', CAST(v + 7 AS STRING), '</td></tr><tr><td>short</td></tr>',
    '<tr><td>Coordinates</td><td>', CASE WHEN v % 5 = 0 THEN 'n/a, 1' ELSE concat(CAST(v % 90 AS STRING), '.25, -', CAST(v % 180 AS STRING), '.5') END, '</td></tr>',
    '<tr><td>KG ID</td><td><a href="#">/g/', CAST(v AS STRING), '</a></td></tr>',
    CASE v % 6 WHEN 0 THEN '' WHEN 1 THEN '<tr><td>Attributes</td><td>many</td></tr>'
        ELSE concat('<tr><td>Attributes</td><td>', CAST(v % 12 AS STRING), ' - Show</td></tr>') END, '</table>')"""


def boxes(spark: SparkSession, sf_dir: str, of: str = "p_partkey") -> DataFrame:
    return spread(table(spark, sf_dir, "part")).selectExpr(
        "p_partkey AS page_id", f"{of} AS _of", "p_name", "p_type", "p_brand",
        "explode(sequence(1, CAST(1 + p_partkey % 4 AS INT))) AS position",
    ).withColumn("v", F.expr("_of * 10 + position")).drop("_of")


def panel_capture(spark: SparkSession, sf_dir: str, of: str = "p_partkey") -> DataFrame:
    """Panels of the odd-numbered containers."""
    return boxes(spark, sf_dir, of).where("v % 2 = 1").selectExpr(
        "page_id", "position", f"{PANEL} AS panel_html",
        "CASE v % 3 WHEN 0 THEN '//maps.example.com/default_geocode-1x.png' WHEN 1 THEN NULL ELSE 'https://lh5.example.com/p' END AS image_src",
    )
