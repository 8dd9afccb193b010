"""Scalar function queries, each over a whole driver table."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectry.catalog import standins as st
from prospectry.catalog.registry import query
from prospectry.functions import lists, text, urls


def _s(column: str) -> str:
    return f"CAST({column} AS STRING)"


@query("query_slug", f"SELECT o_orderkey AS page_id, {st.SEARCH_SLUG_SQL} AS slug FROM orders")
def query_slug(spark, d):
    return st.searches(spark, d).select("page_id", urls.query_slug(F.col("query_url")).alias("slug"))


@query(
    "clean_text",
    r"""SELECT doc_id, nullif(trim(regexp_replace(text, '[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+', ' ', 'g')), '') AS cleaned
    FROM documents""",
)
def clean_text(spark, d):
    return st.table(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


_NUMBER_TEXT = f"concat('about (', {_s('c_custkey % 999 + 1')}, ',', {_s('c_custkey % 10')}, '00.5) of ', {_s('c_acctbal')})"


@query(
    "extract_int",
    "SELECT c_custkey, CAST((c_custkey % 999 + 1) * 1000 + (c_custkey % 10) * 100 AS BIGINT) AS n FROM customer WHERE c_custkey % 10 > 0 "
    "UNION ALL SELECT c_custkey, CAST(concat(CAST(c_custkey % 999 + 1 AS STRING), '000') AS INT) FROM customer WHERE c_custkey % 10 = 0",
)
def extract_int(spark, d):
    rows = st.table(spark, d, "customer").withColumn("t", F.expr(_NUMBER_TEXT))
    return rows.select("c_custkey", text.extract_int(F.col("t")).alias("n"))


@query("extract_float", "SELECT c_custkey, abs(c_acctbal) AS x FROM customer")
def extract_float(spark, d):
    rows = st.table(spark, d, "customer").withColumn("t", F.expr(f"concat('balance: ', {_s('c_acctbal')}, ',7')"))
    return rows.select("c_custkey", text.extract_float(F.col("t")).alias("x"))


_RAW_CATEGORY = """CASE p_size % 5 WHEN 0 THEN concat('  ', p_type, '  ', p_brand, ' : ') WHEN 1 THEN 'GMB  Cat.:'
    WHEN 2 THEN ' Find More' WHEN 3 THEN ' : ' ELSE p_type END"""


@query(
    "normalize_category",
    """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN concat(p_type, ' ', p_brand) WHEN 1 THEN 'GMB Cat.' WHEN 2 THEN 'Find More'
        WHEN 3 THEN '' ELSE p_type END AS category, p_size % 5 IN (1, 2) AS noise FROM part""",
)
def normalize_category(spark, d):
    rows = st.table(spark, d, "part").withColumn("c", F.expr(_RAW_CATEGORY))
    return rows.select(
        "p_partkey", text.normalize_category(F.col("c")).alias("category"), text.is_noise_category(F.col("c")).alias("noise")
    )


@query(
    "parse_categories",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber IN (2, 3, 4, 5)
        THEN concat('Type ', CAST(l_suppkey % 5 AS STRING), '/Brand ', CAST(l_partkey % 25 AS STRING))
        WHEN l_linenumber = 7 THEN concat('{"type": ', CAST(l_suppkey % 5 AS STRING), '}') ELSE '' END AS categories FROM lineitem""",
)
def parse_categories(spark, d):
    rows = st.parsed_listings(spark, d)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("categories", "/").alias("categories"))


_LIST_CELL = """CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN concat('[1, ', CAST(l_suppkey AS STRING), ', null]')
    WHEN 3 THEN concat('[''a'', ''', CAST(l_suppkey AS STRING), ''']') WHEN 4 THEN CAST(l_suppkey AS STRING)
    WHEN 5 THEN concat('x, ', CAST(l_suppkey AS STRING)) WHEN 6 THEN concat('(7, ', CAST(l_suppkey AS STRING), ')') ELSE '"q, r"' END"""


@query(
    "parse_list_cell",
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN concat('1/', CAST(l_suppkey AS STRING), '/None')
        WHEN 3 THEN concat('a/', CAST(l_suppkey AS STRING)) WHEN 4 THEN CAST(l_suppkey AS STRING) WHEN 5 THEN concat('x, ', CAST(l_suppkey AS STRING))
        WHEN 6 THEN concat('7/', CAST(l_suppkey AS STRING)) ELSE 'q, r' END AS items FROM lineitem""",
)
def parse_list_cell(spark, d):
    rows = st.table(spark, d, "lineitem").withColumn("cell", F.expr(_LIST_CELL))
    return rows.select(
        "l_orderkey", "l_linenumber", F.array_join(lists.parse_list_cell(F.col("cell")), "/").alias("items")
    )


@query(
    "to_integer",
    "SELECT o_orderkey, coalesce(TRY_CAST(split_part(o_orderpriority, '-', 1 + CAST(o_orderkey % 2 AS INT)) AS INT), -1) AS n FROM orders",
)
def to_integer(spark, d):
    part = F.split_part("o_orderpriority", F.lit("-"), (1 + F.col("o_orderkey") % 2).cast("int"))
    return st.table(spark, d, "orders").select("o_orderkey", text.to_integer(part, -1).alias("n"))


_FILES = "concat(p_name, '.', CAST(p_partkey AS STRING), '.csv'), concat(p_type, CASE WHEN p_size % 3 = 0 THEN repeat('x', 110) ELSE '' END, '.json'), p_brand"


@query(
    "combined_name",
    f"""WITH f AS (SELECT p_partkey, p_name, p_type, p_brand, p_size, concat(p_name, '.', CAST(p_partkey AS STRING)) AS a,
        concat(p_type, CASE WHEN p_size % 3 = 0 THEN repeat('x', 110) ELSE '' END) AS b FROM part)
    SELECT p_partkey, concat(CASE WHEN length(concat(a, '__', b, '__', p_brand)) > 120
        THEN concat('combined_3_', substr(md5(concat(a, '.csv__', b, '.json__', p_brand)), 1, 10)) ELSE concat(a, '__', b, '__', p_brand) END, '.csv') AS name FROM f""",
)
def combined_name(spark, d):
    return st.table(spark, d, "part").selectExpr("p_partkey", f"array({_FILES}) AS files").select(
        "p_partkey", lists.combined_name(F.col("files")).alias("name")
    )


@query(
    "map_details",
    """SELECT o_orderkey, concat('- roofers_', CAST(o_custkey AS STRING), ' (#pos ', CAST(o_orderkey % 20 AS STRING), ', sv ',
        CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(CAST(o_custkey AS DOUBLE) AS STRING) END, ')', chr(10),
        '- plain.csv (#pos ', CASE WHEN o_orderkey % 2 = 0 THEN '3' ELSE '' END, ', sv )') AS details FROM orders""",
)
def map_details(spark, d):
    rows = st.table(spark, d, "orders").selectExpr(
        "o_orderkey", "array(concat('roofers_', o_custkey, '_@1_2_z.csv'), 'plain.csv') AS files",
        "CASE WHEN o_orderkey % 2 = 0 THEN array(o_orderkey % 20, 3) ELSE array(o_orderkey % 20) END AS positions",
        "array(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END) AS volumes",
    )
    return rows.select("o_orderkey", lists.map_details(F.col("files"), F.col("positions"), F.col("volumes")).alias("details"))


@query(
    "join_list",
    """SELECT p_partkey, concat(p_type, ' | ', p_brand) AS categories, concat(CAST(p_size AS STRING), ', 7') AS positions,
        concat(p_name, chr(10), p_brand) AS files FROM part""",
)
def join_list(spark, d):
    return st.table(spark, d, "part").select(
        "p_partkey", lists.join_categories(F.array("p_type", "p_brand")).alias("categories"),
        lists.join_positions(F.array("p_size", F.lit(7))).alias("positions"),
        lists.join_files(F.array("p_name", "p_brand")).alias("files"),
    )


@query("url_host", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?]*)', 1) AS host FROM pages")
def url_host(spark, d):
    return st.raw_pages(spark, d).select("page_id", urls.url_host(F.col("url")).alias("host"))


_SHORT_URL = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'shop.firm.co.uk:8080/a' WHEN 2 THEN replace(url, '.example', '.me.uk.ab') ELSE 'localhost?x=1' END"


@query(
    "root_domain",
    r"""WITH h AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^[a-z]+://([^/:?]*)', 1) WHEN 1 THEN 'shop.firm.co.uk'
        WHEN 2 THEN regexp_extract(replace(url, '.example', '.me.uk.ab'), '^[a-z]+://([^/:?]*)', 1) ELSE 'localhost' END AS host FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(host, '\.[^.]{2}\.[^.]{2}$') AND len(string_split(host, '.')) > 2
        THEN regexp_extract(host, '([^.]+\.[^.]{2}\.[^.]{2})$', 1) WHEN len(string_split(host, '.')) > 2
        THEN regexp_extract(host, '([^.]+\.[^.]+)$', 1) ELSE host END AS root_domain FROM h""",
)
def root_domain(spark, d):
    rows = st.raw_pages(spark, d).withColumn("u", F.expr(_SHORT_URL))
    return rows.select("page_id", urls.root_domain(F.col("u")).alias("root_domain"))


_PLACE_ID = """CASE o_orderkey % 5 WHEN 0 THEN concat('1000000000', lpad(CAST(o_orderkey AS STRING), 9, '0'), ' ')
    WHEN 1 THEN concat('ChIJ', CAST(o_custkey AS STRING)) WHEN 2 THEN concat('/g/', CAST(o_custkey AS STRING))
    WHEN 3 THEN concat('/m/0', CAST(o_custkey AS STRING)) ELSE CAST(o_orderkey AS STRING) END"""


@query(
    "classify_place_id",
    f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'cid' WHEN 1 THEN 'place_id' WHEN 4 THEN NULL ELSE 'kg' END AS kind,
        CASE o_orderkey % 5 WHEN 0 THEN concat('https://www.google.com/maps?cid=', trim({_PLACE_ID}))
            WHEN 1 THEN concat('https://www.google.com/maps/place/?q=place_id:', {_PLACE_ID}) WHEN 4 THEN NULL
            ELSE concat('https://g.co/kg', {_PLACE_ID}) END AS lookup_url FROM orders""",
)
def classify_place_id(spark, d):
    rows = st.table(spark, d, "orders").withColumn("id", F.expr(_PLACE_ID))
    return rows.select("o_orderkey", urls.classify_place_id(F.col("id")).alias("p")).select("o_orderkey", "p.*")


_HEX = "substr(md5(CAST(o_orderkey AS STRING)), 1, CASE WHEN o_orderkey % 2 = 0 THEN 16 ELSE 11 END)"


@query("fid_to_cid", f"SELECT o_orderkey, CAST(CAST(concat('0x', {_HEX}) AS UBIGINT) AS STRING) AS cid FROM orders")
def fid_to_cid(spark, d):
    rows = st.table(spark, d, "orders").withColumn("fid", F.expr(f"concat('0x87', CAST(o_custkey AS STRING), ':0x', {_HEX})"))
    return rows.select("o_orderkey", urls.fid_to_cid(F.col("fid")).alias("cid"))


@query(
    "extract_place_ids",
    f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('0x1:0x', {_HEX}) WHEN 1 THEN concat('0xab:0x', {_HEX}) ELSE '0' END AS fid,
        CASE WHEN o_orderkey % 3 = 0 THEN concat('ChIJ', CAST(o_custkey AS STRING)) ELSE '0' END AS place_id,
        CASE WHEN o_orderkey % 4 < 2 THEN CAST(CAST(concat('0x', {_HEX}) AS UBIGINT) AS STRING) ELSE '0' END AS cid FROM orders""",
)
def extract_place_ids(spark, d):
    rows = st.table(spark, d, "orders").selectExpr(
        "o_orderkey",
        f"""concat('<p>x</p>', CASE WHEN o_orderkey % 4 = 0 THEN concat('<div a="1" data-fid="0x1:0x', {_HEX}, '" b>') ELSE '<div>' END,
            CASE WHEN o_orderkey % 3 = 0 THEN concat('<b data-pid=''ChIJ', CAST(o_custkey AS STRING), ''' c>') ELSE '<b data-pid="zz" c>' END) AS html""",
        f"CASE WHEN o_orderkey % 4 < 2 THEN concat('https://m.example.com/data=!1s0xab:0x', {_HEX}, '!8m2') ELSE 'https://m.example.com/' END AS url",
    )
    return rows.select("o_orderkey", urls.extract_place_ids(F.col("html"), F.col("url")).alias("p")).select("o_orderkey", "p.*")


@query(
    "site_urls",
    """SELECT page_id, replace(url, 'https://', 'http://') AS http_url, split_part(url, '/', 3) AS domain,
        concat('http://', split_part(url, '/', 3)) AS base_url FROM pages""",
)
def site_urls(spark, d):
    rows = st.raw_pages(spark, d).withColumn("u", F.concat(F.lit(" "), "url", F.lit("\n")))
    return rows.select("page_id", urls.site_urls(F.col("u")).alias("s")).select("page_id", "s.*")


@query(
    "photo_url",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('https://lh5.example.com/p/AF', CAST(c_custkey AS STRING), '+q=w800-h600-k-no') END AS sized,
        concat('https://lh5.googleusercontent.com/p/', c_name, '=w1920-h912-k-no') AS by_id FROM customer""",
)
def photo_url(spark, d):
    rows = st.table(spark, d, "customer").withColumn(
        "u", F.expr("""CASE WHEN c_custkey % 3 = 0 THEN 'https://maps.example.com/place/x'
            ELSE concat('https://maps.example.com/maps/place/!1shttps:%2F%2Flh5.example.com%2Fp%2FAF', CAST(c_custkey AS STRING), '+q%3Dw203-h100!7i') END""")
    )
    return rows.select("c_custkey", urls.photo_url(F.col("u"), 800, 600).alias("sized"), urls.photo_url_from_id(F.col("c_name")).alias("by_id"))


@query(
    "format_coords",
    """SELECT c_custkey, concat(CAST(c_custkey % 90 AS STRING), '.12500000, -', CAST(c_custkey % 180 AS STRING), '.50000000') AS shown,
        CAST(c_custkey % 90 AS DOUBLE) + 0.125 AS latitude, -(CAST(c_custkey % 180 AS DOUBLE) + 0.5) AS longitude FROM customer""",
)
def format_coords(spark, d):
    rows = st.table(spark, d, "customer").select(
        "c_custkey",
        urls.format_coords(F.col("c_custkey") % 90 + F.lit(0.125), -(F.col("c_custkey") % 180 + F.lit(0.5))).alias("shown"),
    )
    pair = urls.parse_coords(F.col("shown"))
    return rows.select("c_custkey", "shown", F.get(pair, 0).alias("latitude"), F.get(pair, 1).alias("longitude"))


@query("kg_url", "SELECT c_custkey, concat('https://www.google.com/search?kgmid=/g/', CAST(c_custkey AS STRING)) AS kg_id FROM customer")
def kg_url(spark, d):
    rows = st.table(spark, d, "customer")
    return rows.select("c_custkey", urls.kg_url(F.expr("concat('/g/', CAST(c_custkey AS STRING))")).alias("kg_id"))


@query(
    "url_param",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat('Lake City+', c_mktsegment, '/', CAST(c_custkey AS STRING)) WHEN 1 THEN '5% off' ELSE NULL END AS place FROM customer""",
)
def url_param(spark, d):
    rows = st.table(spark, d, "customer").withColumn(
        "u", F.expr("""CASE c_custkey % 3 WHEN 0 THEN concat('https://x.example.com/?a=1&search-location=Lake%20City+', c_mktsegment, '%2F', CAST(c_custkey AS STRING), '&b=2')
            WHEN 1 THEN '/?search-location=5%%20off' ELSE '/?location=x' END""")
    )
    return rows.select("c_custkey", urls.url_param(F.col("u"), "search-location").alias("place"))


@query("sha1", "SELECT doc_id, sha1(text) AS digest FROM documents")
def sha1(spark, d):
    return st.table(spark, d, "documents").select("doc_id", F.sha1("text").alias("digest"))


_WORDS = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))"


@query("document_words", f"SELECT doc_id, CAST({_WORDS} AS INT) AS words FROM documents")
def document_words(spark, d):
    return st.table(spark, d, "documents").select("doc_id", text.count_words(F.col("text")).alias("words"))


@query(
    "latest_year",
    r"""WITH t AS (SELECT doc_id, concat(text, CASE WHEN doc_id % 5 = 0 THEN concat(' (c) 1999-20', CAST(10 + doc_id % 30 AS STRING), '1 Updated on March 2024') ELSE '' END) AS text FROM documents)
    SELECT doc_id, CAST(list_max(list_transform(regexp_extract_all(text, '20[1-3][0-9]'), lambda y: CAST(y AS INT))) AS INT) AS year,
        regexp_matches(text, '(?i)updated\s*(on|:)?\s*[\p{L}\p{N}_]*\s*[0-9]{4}') AS updated FROM t""",
)
def latest_year(spark, d):
    rows = st.table(spark, d, "documents").withColumn(
        "text", F.expr("""concat(text, CASE WHEN doc_id % 5 = 0 THEN concat(' (c) 1999-20', CAST(10 + doc_id % 30 AS STRING), '1 Updated on March 2024') ELSE '' END)""")
    )
    return rows.select("doc_id", text.latest_year(F.col("text")).alias("year"), text.has_updated_phrase(F.col("text")).alias("updated"))
