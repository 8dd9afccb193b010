"""Listing extraction queries: results pages and panels built from part rows, then parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from prospectry.catalog import standins as st
from prospectry.catalog.registry import query
from prospectry.functions import markup
from prospectry.operators import listings as ex, profile
from prospectry.session import work_path
from prospectry.sources import schemas, writers

_V = "CAST(v AS STRING)"
_ROWS = f"WITH b AS ({st.BOXES_SQL})"
_BROKEN = "v % 6 = 2"


def _unless_broken(expr: str) -> str:
    return f"CASE WHEN {_BROKEN} THEN NULL ELSE {expr} END"


# What each field must be, from the numbers the container was built of.
FIELDS = {
    "name": _unless_broken(f"CASE WHEN v % 3 = 0 THEN concat('Shop ', p_name, ' ', {_V}) ELSE concat('Firm & Co ', {_V}) END"),
    "categories": f"CASE WHEN {_BROKEN} THEN '' WHEN v % 5 = 0 THEN concat(p_type, '/', p_brand) ELSE p_type END",
    "rating": _unless_broken("CASE WHEN v % 4 = 0 THEN NULL ELSE CAST(concat(CAST(3 + v % 2 AS STRING), '.', CAST(v % 10 AS STRING)) AS DOUBLE) END"),
    "reviews_count": _unless_broken("CASE WHEN v % 4 = 0 THEN NULL ELSE CAST(1100 + v % 900 AS BIGINT) END"),
    "address": _unless_broken(f"concat({_V}, ' Main St')"),
    "phone": _unless_broken(f"CASE WHEN v % 2 = 1 THEN concat('+1 555 ', {_V}) ELSE NULL END"),
    "website": _unless_broken(f"CASE WHEN v % 6 = 0 THEN concat('https://www.site', {_V}, '.example.com/') ELSE NULL END"),
    "listing_link": _unless_broken(f"CASE WHEN v % 7 = 0 THEN NULL ELSE concat('https://maps.example.com/place/', {_V}) END"),
    "status": f"""CASE WHEN {_BROKEN} THEN 'parse_error: ''NoneType'' object has no attribute ''startswith''' WHEN v % 2 = 1
        THEN concat(p_type, ' · ', {_V}, ' Main St Open · Closes 5 PM +1 555 ', {_V}) ELSE NULL END""",
}


def _sql(*fields: str) -> str:
    return f"{_ROWS} SELECT page_id, position, {', '.join(f'{FIELDS[f]} AS {f}' for f in fields)} FROM b"


def _captured(spark, pages, text="html"):
    """Pages as a capture job stores them: in files that a task each can parse."""
    return writers.write_pages(pages, work_path(spark, "pages"), text)


def _listings(spark, d):
    return ex.extract_listings(_captured(spark, st.results_pages(spark, d)))


def _shown(df, *fields):
    joined = F.array_join("categories", "/").alias("categories")
    return df.select("page_id", "position", *[joined if f == "categories" else F.col(f) for f in fields])


@query("extract_listings", _sql(*FIELDS))
def extract_listings(spark, d):
    return _shown(_listings(spark, d), *FIELDS)


@query("listing_fields", _sql("name", "listing_link", "rating", "reviews_count"))
def listing_fields(spark, d):
    return _shown(_listings(spark, d), "name", "listing_link", "rating", "reviews_count")


@query("listing_categories", _sql("categories"))
def listing_categories(spark, d):
    return _shown(_listings(spark, d), "categories")


@query("listing_lines", _sql("address", "phone", "status"))
def listing_lines(spark, d):
    return _shown(_listings(spark, d), "address", "phone", "status")


@query("listing_website", _sql("website", "status"))
def listing_website(spark, d):
    return _shown(_listings(spark, d), "website", "status")


@query(
    "result_position",
    f"{_ROWS} SELECT position, count(*) AS listings, sum(page_id) AS pages FROM b GROUP BY position",
)
def result_position(spark, d):
    return _listings(spark, d).groupBy("position").agg(F.count("*").alias("listings"), F.sum("page_id").alias("pages"))


@query("first_match", f"{_ROWS} SELECT page_id, max(CASE WHEN position = 1 THEN {FIELDS['name']} END) AS name FROM b GROUP BY page_id")
def first_match(spark, d):
    boxes = markup.parse_column(
        st.results_pages(spark, d), "html", markup.results_page_facts, T.ArrayType(schemas.LISTING_MARKUP), "boxes"
    )
    first = boxes.select("page_id", ex.first_match(F.col("boxes")).alias("box"))
    return ex.with_listing_fields(first, "box").select("page_id", "name")


# --- panels --------------------------------------------------------------------------------

_PANELS = {
    "gbp_company": f"concat('Firm ', {_V})",
    "gbp_is_verified": "CASE v % 3 WHEN 0 THEN false WHEN 1 THEN true ELSE NULL END",
    "categories": "CASE WHEN v % 4 = 1 THEN '' ELSE 'Roofer/Painter' END",
    "place_id": f"concat('ChIJ', {_V})",
    "CID": "CAST(v * 1000003 AS STRING)",
    "business_profile_id": "CAST(v + 7 AS STRING)",
    "latitude": "CASE WHEN v % 5 = 0 THEN NULL ELSE CAST(v % 90 AS DOUBLE) + 0.25 END",
    "longitude": "CASE WHEN v % 5 = 0 THEN NULL ELSE -(CAST(v % 180 AS DOUBLE) + 0.5) END",
    "kg_id": f"concat('https://www.google.com/search?kgmid=/g/', {_V})",
    "attributes": "CASE WHEN v % 6 IN (0, 1) THEN -1 ELSE CAST(v % 12 AS INT) END",
    "gbp_has_image": "v % 3 = 2",
}
_PANEL_ROWS = f"SELECT page_id, position, {', '.join(f'{e} AS {n}' for n, e in _PANELS.items())} FROM b WHERE v % 2 = 1"


def _panels(spark, d):
    return ex.extract_panels(_captured(spark, st.panel_capture(spark, d), "panel_html"))


@query("extract_panels", f"{_ROWS} {_PANEL_ROWS}")
def extract_panels(spark, d):
    return _panels(spark, d).withColumns(
        {
            "categories": F.array_join("categories", "/"), "latitude": F.get("coordinates", 0),
            "longitude": F.get("coordinates", 1),
        }
    ).drop("coordinates")


@query("has_listing_image", f"{_ROWS} SELECT page_id, position, v % 3 = 2 AS has_image FROM b WHERE v % 2 = 1")
def has_listing_image(spark, d):
    captured = st.panel_capture(spark, d)
    return captured.select("page_id", "position", ex.has_listing_image(F.col("image_src")).alias("has_image"))


@query(
    "merge_panel_fields",
    f"""{_ROWS}, p AS ({_PANEL_ROWS}) SELECT b.page_id, b.position, {FIELDS['name']} AS name,
        coalesce(p.categories, {FIELDS['categories']}) AS categories, p.place_id, p.gbp_is_verified, p.attributes, p.gbp_has_image
    FROM b LEFT JOIN p ON b.page_id = p.page_id AND b.position = p.position""",
)
def merge_panel_fields(spark, d):
    return ex.merge_panel_fields(_listings(spark, d), _panels(spark, d)).select(
        "page_id", "position", "name", F.array_join("categories", "/").alias("categories"),
        "place_id", "gbp_is_verified", "attributes", "gbp_has_image",
    )


@query(
    "struct_override",
    "SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag AS a, coalesce(CASE WHEN l_suppkey % 2 = 0 THEN l_linestatus END, 'left') AS b FROM lineitem",
)
def struct_override(spark, d):
    rows = st.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey",
        F.struct(F.col("l_returnflag").alias("a"), F.lit("left").alias("b")).alias("left"),
        F.struct(F.when(F.col("l_suppkey") % 2 == 0, F.col("l_linestatus")).alias("b")).alias("right"),
    )
    merged = ex.struct_override(F.col("left"), F.col("right"), ["a", "b"], ["b"])
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", merged.alias("m")).select("l_orderkey", "l_linenumber", "l_suppkey", "m.*")


# --- lookups that annotate a results page --------------------------------------------------


def _lookups(spark, d):
    """Answers of the lookup service: one per odd container, a third of them without a name."""
    return st.boxes(spark, d).where("v % 2 = 1").selectExpr(
        "page_id", "position", "CASE WHEN v % 3 = 0 THEN NULL ELSE p_name END AS name", f"{_V} AS cid",
        "array(p_type, p_brand) AS categories", "v % 4 = 1 AS verified", "v % 1000 AS distance",
    )


@query(
    "annotate_results",
    f"""{_ROWS} SELECT page_id, position, {', '.join(
        f"CASE WHEN v % 2 = 1 AND v % 3 <> 0 THEN {e} ELSE NULL END AS {n}" for n, e in {
            "cid": _V, "category_text": "concat(p_type, ', ', p_brand)", "verified": "v % 4 = 1",
            "distance_text": "concat('Distance: ', CAST(v % 1000 AS STRING), ' m')"}.items())} FROM b""",
)
def annotate_results(spark, d):
    results = st.boxes(spark, d).select("page_id", "position")
    return ex.annotate_results(results, _lookups(spark, d))


_COUNTED = """c AS (SELECT page_id, unnest(CASE WHEN position % 2 = 0 THEN [p_type, p_brand, 'Any'] ELSE [p_type] END) AS category
    FROM b WHERE v % 3 <> 0)"""


@query(
    "category_histogram",
    f"""{_ROWS}, {_COUNTED}, t AS (SELECT page_id, count(*) AS listings FROM c GROUP BY page_id HAVING count(*) > 1)
    SELECT page_id, category, count(*) AS listings FROM c WHERE page_id IN (SELECT page_id FROM t) GROUP BY page_id, category
    UNION ALL SELECT page_id, 'Total Categories', listings FROM t""",
)
def category_histogram(spark, d):
    rows = st.boxes(spark, d).selectExpr(
        "page_id", "CASE WHEN v % 3 = 0 THEN NULL ELSE p_name END AS name",
        "CASE WHEN position % 2 = 0 THEN array(p_type, p_brand, 'Any') ELSE array(p_type) END AS categories",
    )
    return ex.category_histogram(rows, ["page_id"])


@query(
    "segment_histogram",
    """SELECT n_name, c_mktsegment AS category, count(*) AS listings FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment
    UNION ALL SELECT n_name, 'Total Categories', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def segment_histogram(spark, d):
    nations = st.table(spark, d, "nation")
    rows = st.table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return ex.category_histogram(rows.select("n_name", F.col("c_name").alias("name"), F.array("c_mktsegment").alias("categories")), ["n_name"])


@query(
    "default_display",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(p_size AS STRING) END AS reviews_count,
        CASE WHEN p_size % 4 = 0 THEN '' ELSE CAST(CAST(p_size AS DOUBLE) / 2 AS STRING) END AS rating,
        CASE WHEN p_size % 5 = 0 THEN 'hidden' ELSE p_name END AS address FROM part""",
)
def default_display(spark, d):
    return ex.default_display(st.table(spark, d, "part").selectExpr(
        "p_partkey", "CASE WHEN p_size % 3 <> 0 THEN p_size END AS reviews_count",
        "CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS DOUBLE) / 2 END AS rating",
        "CASE WHEN p_size % 5 <> 0 THEN p_name END AS address",
    ))


@query(
    "contact_flags",
    f"""WITH l AS ({st.LISTINGS_SQL}) SELECT l_orderkey, l_linenumber, l_partkey, coalesce(phone, '') LIKE '+%' AS "phoneStartsWithPlus",
        coalesce(phone, '') <> '' AS "hasPhone", coalesce(address, '') <> '' AS "hasAddress",
        CASE WHEN l_linenumber IN (2, 3, 4, 5) THEN 2 WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS n_categories FROM l""",
)
def contact_flags(spark, d):
    rows = st.parsed_listings(spark, d)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[c.alias(n) for n, c in profile.contact_flags().items()])
