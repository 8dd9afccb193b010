"""Page reading on hand-written HTML."""

import pytest
from pyspark.sql import functions as F

from prospectry.functions.markup import panel_facts, read_html, results_page_facts, site_page_facts
from prospectry.operators import captures, listings as ex, site


def test_tree_keeps_what_is_written():
    page = read_html("<div><p>one<b>two<p>three</div><!-- no --><span>4 &amp; 5</span></p>")
    assert [e.name for e in page.all()] == ["div", "p", "b", "p", "span"]
    assert page.text("|") == "one|two|three|4 & 5"
    deep = read_html("<p><b>" * 20000 + "end")
    assert deep.text() == "end"


def test_script_text_is_not_page_text():
    facts = site_page_facts(
        "<title>T</title><script>var a = '<p>no</p>'</script><style>p{}</style><template><p>no</p></template>"
        "<noscript>only <b>without</b></noscript><p>yes<!-- c -->no gap</p><svg><title>2</title></svg><img><IMG/>"
    )
    assert facts["text"] == "T yes no gap 2" and facts["full_text"] == "T only without yes no gap 2"
    assert facts["title"] == "T" and facts["img_count"] == 2
    assert facts["scripts"] == [{"src": None, "body": "var a = '<p>no</p>'"}] and facts["styles"] == ["p{}"]


BOX = '<div class="Nv2PK">{}</div>'
FULL = '<div class="Nv2PK tH5CWc THOPZb">{}</div>'


@pytest.mark.parametrize(
    "html, names",
    [
        (FULL.format('<a class="hfpxzc" aria-label="A" href="https://x"></a>') + BOX.format('<a class="hfpxzc" aria-label="B"></a>'), ["A"]),
        (BOX.format('<a class="hfpxzc" aria-label=" "></a><div class="qBF1Pd">C <i>d</i></div>') * 2, ["C d", "C d"]),
        ("<p>Nv2PK but no container</p>", []),
    ],
)
def test_containers(spark, html, names):
    rows = ex.extract_listings(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("position").collect()
    assert [r.name for r in rows] == names and [r.position for r in rows] == list(range(1, len(names) + 1))


def _one(spark, inner):
    return ex.extract_listings(spark.createDataFrame([(1, BOX.format(inner))], "page_id int, html string")).first()


def test_listing_lines(spark):
    r = _one(spark, '<div class="W4Efsd">Steel fabricator · x · 1401 Umatilla St</div><div class="W4Efsd">Closed · Opens 9 AM <span class="UsdlK">(303) 1</span></div>')
    assert (r.categories, r.address, r.status, r.phone) == (["Steel fabricator"], "1401 Umatilla St", "Closed · Opens 9 AM (303) 1", "(303) 1")
    r = _one(spark, '<div class="W4Efsd">Find more · 12 Long Rd</div><div class="W4Efsd"><span class="UsdlK">1</span></div><div class="W4Efsd">x<span class="UsdlK"> </span></div>')
    assert (r.categories, r.address, r.status, r.phone) == ([], "12 Long Rd", None, None)


def test_listing_website(spark):
    assert _one(spark, '<a aria-label="Their Website" href="/local"></a><a data-value="Website" href="https://y"></a>').website is None
    assert _one(spark, '<a data-value="Website" href="https://y"></a>').website == "https://y"
    failed = _one(spark, '<a class="hfpxzc" aria-label="A" href="https://x"></a><a aria-label="website"></a>')
    assert failed.status.startswith("parse_error: ") and failed.name is None and failed.categories == [] and failed.position == 1


def test_panel(spark):
    html = (
        "<strong>Co</strong><small>Not Verified</small><table><tr><td>Place ID</td><td>header row is skipped</td></tr>"
        "<tr><td>Categories(3)</td><td>A, ,B</td></tr><tr><td>Coordinates</td><td>39.5, -105</td></tr><tr><td>Coordinates</td><td>bad</td></tr>"
        "<tr><td>Attributes</td><td>7 - Show</td></tr></table>"
    )
    assert panel_facts(html)["company"] == "Co"
    rows = spark.createDataFrame([(1, 1, html, "x/default_geocode.png"), (1, 2, None, "y")], "page_id int, position int, panel_html string, image_src string")
    first, second = ex.extract_panels(rows).orderBy("position").collect()
    assert (first.gbp_is_verified, first.categories, first.coordinates, first.attributes, first.place_id, first.gbp_has_image) == (
        False, ["A", "B"], [39.5, -105.0], 7, None, False)
    assert (second.gbp_company, second.attributes, second.gbp_has_image) == (None, None, True)


def test_top_level_media(spark):
    cases = {
        "@media print{p{}}": True, "p{} @MEDIA screen{}": True, "@supports(a){@media b{p{}}}": False, "/* @media x{} */": False,
        "p{content:'@media x{}'}": False, "@mediax{}": False, "@import url(a);@media x{a{}": True, "@layer{@supports(x){@media y{p{a:b}}}}": False, None: False,
        "@supports(a){x:y;" * 8 + "@media b{p{}}" + "}" * 8: False, "@layer{" * 40 + "p{}" + "}" * 40 + "@media b{p{}}": True,
        "@import url(a);;@media x{p{}}": False, "foo; @media x{p{}}": False, "foo{} ; @media x{p{}} @media y{}": True, "@import url(x;y);@media z{}": True,
        "@charset 'a'; @media z;": True, "<!-- @media x{} -->": True, "p) { } @media a{}": True, "@page (;{) {} @media a{}": False, "@page (;) {} @media a{}": True,
    }
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, css string")
    found = rows.select("i", site.has_top_level_media(F.col("css")).alias("m")).orderBy("i").collect()
    assert [r.m for r in found] == list(cases.values())


def test_frameworks_and_builders(spark):
    rows = spark.createDataFrame(
        [(1, "<p _next/ data-reactroot>"), (2, "<p>data-reactroot __vue__</p>"), (3, "<p>plain Shopify.THEME</p>")], "page_id int, html string"
    ).withColumn("source", F.col("html"))
    found = site.page_features(rows).select(
        "page_id", site.detect_frameworks(F.col("source"), F.col("page")).alias("f"), site.site_builders(F.col("source")).alias("b")
    ).orderBy("page_id").collect()
    assert [r.f for r in found] == [["Next.js"], ["React", "Vue"], ["Unknown"]]
    assert [r.b for r in found] == [["Unknown"], ["Unknown"], ["Shopify"]]


def test_sitemaps(spark):
    root = "https://{}.example.com/"
    rows = [
        (root.format("a") + "sitemap.xml", 200, "text/xml", "<urlset><url/><url/><url/></urlset>"),
        (root.format("b") + "sitemap.xml", 200, "text/html", "<urlset/>"),
        (root.format("b") + "sitemap_index.xml", 200, "application/xml; charset=utf-8",
         "<?xml version='1.0'?><sitemapindex xmlns='u'><sitemap><loc>" + root.format("b") + "1.xml</loc></sitemap><sitemap><loc>" + root.format("b") + "2.xml</loc></sitemap></sitemapindex>"),
        (root.format("b") + "1.xml", 200, None, "<urlset><url/></urlset>"), (root.format("b") + "2.xml", 200, "text/xml", "<urlset>"),
        (root.format("c") + "sitemap.xml", 200, "text/xml", "<broken"), (root.format("c") + "sitemap-index.xml", 200, "text/xml", "<also"),
    ]
    captured = spark.createDataFrame(rows, "url string, status_code int, content_type string, body string")
    domains = spark.createDataFrame([(f"{x}.example.com",) for x in "abcd"], "domain string")
    found = {r.domain[0]: (r.sitemap_found and r.sitemap_found.rsplit("/", 1)[1], r.total_pages) for r in captures.check_sitemaps(domains, captured).collect()}
    assert found == {"a": ("sitemap.xml", 3), "b": ("sitemap_index.xml", 1), "c": ("sitemap-index.xml", 0), "d": (None, 0)}


def test_repeated_captures(spark):
    url = "https://a.example.com/sitemap.xml"
    rows = [(url, 200, "text/xml", "<urlset><url/><url/></urlset>", "2026-01-01"), (url, 503, "text/xml", "busy", "2026-01-02"),
            (url, 200, "text/xml", "<urlset><url/><url/><url/></urlset>", "2025-01-01")]
    captured = spark.createDataFrame(rows, "url string, status_code int, content_type string, body string, at string").withColumn("fetched_at", F.to_timestamp("at"))
    domains = spark.createDataFrame([("a.example.com",)], "domain string")
    assert captures.check_sitemaps(domains, captured).first().total_pages == 2
    log = spark.createDataFrame(
        [(1, "http", "GET", 200, None, None, "Wed, 1 Jan 2020"), (1, "http", "GET", 500, None, None, None), (1, "https", "HEAD", None, "ssl", "bad name", None),
         (2, "https", "HEAD", 405, None, None, "Mon, 1 Jan 2024"), (2, "https", "GET", 200, None, None, "Wed, 1 Jan 2025"),
         (3, "https", "HEAD", None, "other", "timeout", None), (3, "https", "GET", None, "other", "reset", None)],
        "page_id long, scheme string, method string, status_code int, error_kind string, error_text string, last_modified string",
    ).withColumn("final_url", F.lit("http://x")).withColumn("load_seconds", F.lit(None).cast("double"))
    found = captures.fetch_summary(log).select("page_id", "last_modified", captures.http_policy(F.lit("d")).alias("h")).orderBy("page_id").collect()
    one, two, three = found
    assert (one.h.http_allowed, one.h.status_code, one.h.ssl_bad, one.h.ssl_error, one.last_modified) == (True, None, True, "bad name", None)
    assert (two.h.https_status_code, two.h.ssl_bad, two.last_modified) == (405, False, "Mon, 1 Jan 2024")
    assert (three.h.ssl_bad, three.h.https_error, three.h.ssl_error) == (None, "reset", None)


def test_resolve_href(spark):
    from urllib.parse import urldefrag, urljoin

    from prospectry.functions.urls import resolve_href

    links = ["css/../a.css", "/a/./b.css", "?v=1", "../x", "a//b", "/a//b", "./", "..", "a/..", "/..", "x?q=../y", "//c/d", "https://e/f", "a#b", "", "a/../../b/c", "/a/b/.."]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(links)], "i int, href string")
    found = rows.select("i", resolve_href(F.lit("http://d"), F.col("href")).alias("u")).orderBy("i").collect()
    assert [r.u for r in found] == [urldefrag(urljoin("http://d", x)).url for x in links]


def test_pages_are_made_by_many_tasks(spark):
    from prospectry.catalog import standins

    spread = standins.spread(spark.range(3 * standins.PAGE_ROWS).coalesce(1))
    sizes = [len(p) for p in spread.rdd.glom().collect()]
    assert len(sizes) == 3 and sum(sizes) == 3 * standins.PAGE_ROWS and max(sizes) < 2 * standins.PAGE_ROWS
