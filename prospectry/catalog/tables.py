"""Reader and writer queries. Written tables go to the session's shared folder, a new path each."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectry.catalog import standins as st
from prospectry.catalog.merging import MERGED_SQL, shown
from prospectry.catalog.registry import query
from prospectry.catalog.searching import outcomes
from prospectry.functions.urls import query_slug
from prospectry.operators import merge
from prospectry.session import work_path
from prospectry.sources import readers, schemas, writers


@query("scan_queries", "SELECT page_id, url AS query_url, '' AS status, CAST(NULL AS DOUBLE) AS search_volume FROM pages")
def scan_queries(spark, d):
    return readers.scan_queries(spark, f"{d}/pages.parquet").select("page_id", "query_url", "status", "search_volume")


_NULLS = {f.name: f.dataType.simpleString() for f in schemas.LISTINGS.fields}


@query(
    "scan_listings",
    "SELECT s_suppkey, s_name, " + ", ".join(f"CAST(NULL AS {t}) AS {n}" for n, t in _NULLS.items()) + " FROM supplier",
)
def scan_listings(spark, d):
    return readers.scan_listings(spark, f"{d}/supplier.parquet").select("s_suppkey", "s_name", *_NULLS)


@query(
    "scan_with_provenance",
    """SELECT 'supplier.parquet' AS map_file, 0 AS file_idx, s_suppkey AS row_idx, s_name, CAST(NULL AS STRING) AS c_name FROM supplier
    UNION ALL SELECT 'customer.parquet', 1, c_custkey, NULL, c_name FROM customer""",
)
def scan_with_provenance(spark, d):
    rows = readers.scan_with_provenance(spark, [f"{d}/supplier.parquet", f"{d}/customer.parquet"])
    return rows.select("map_file", "ord.file_idx", "ord.place.row_idx", "s_name", "c_name")


@query(
    "scan_combined",
    f"WITH p AS ({st.PARENT_SQL}) SELECT file_idx, row_idx, name, status FROM p WHERE lower(trim(status)) = 'pending'",
)
def scan_combined(spark, d):
    """Writes one merged table per file number, then reads them with one that is missing."""
    root = work_path(spark, "combined")
    st.merged_parent(spark, d).drop("row_idx").write.partitionBy("file_idx").parquet(root)
    paths = [f"{root}/file_idx={i}" for i in range(3)] + [f"{root}/absent"]
    rows = readers.scan_combined(spark, paths, "pending")
    return rows.select("file_idx", F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("row_idx"), "name", "status")


@query("scan_pages", "SELECT page_id, url, html FROM pages")
def scan_pages(spark, d):
    return readers.scan_pages(spark, f"{d}/pages.parquet")


@query("scan_captures", "SELECT page_id, url, md5(html) AS digest FROM pages")
def scan_captures(spark, d):
    return readers.scan_captures(spark, f"{d}/pages.parquet", schemas.PAGES).select("page_id", "url", F.md5("html").alias("digest"))


@query("scan_evaluations", "SELECT event_id, user_id, event_type FROM events")
def scan_evaluations(spark, d):
    """The log, and an absent log as an empty one."""
    empty = readers.scan_evaluations(spark, f"{d}/no-such-log.parquet")
    log = readers.scan_evaluations(spark, f"{d}/events.parquet").select("event_id", "user_id", "event_type")
    return log.unionByName(empty, allowMissingColumns=True).select("event_id", "user_id", "event_type")


@query("scan_place_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id % 3 > 0 AS valid FROM events WHERE event_id % 3 > 0 UNION ALL SELECT event_id, NULL, false FROM events WHERE event_id % 3 = 0")
def scan_place_json(spark, d):
    body = F.when(F.col("event_id") % 3 == 0, F.lit(")]}'\nnot json")).otherwise(F.concat(F.lit(")]}'\n"), "props"))
    rows = st.table(spark, d, "events").select("event_id", body.alias("body"))
    parsed = readers.parse_guarded_json(F.col("body"))
    return rows.select("event_id", readers.place_field(F.col("body"), "$.k", "int").alias("k"), parsed.isNotNull().alias("valid"))


# --- writers -------------------------------------------------------------------------------

_SLUGGED = f"SELECT o_orderkey AS page_id, {st.SEARCH_SLUG_SQL} AS slug, o_custkey % 100 AS o_custkey FROM orders"


@query(
    "write_listings",
    """SELECT l_orderkey, l_linenumber, l_suppkey % 40 AS supplier, concat('s', CAST(l_suppkey % 40 AS STRING)) AS slug,
        l_quantity + CASE WHEN l_suppkey % 40 < 5 THEN 1 ELSE 0 END AS l_quantity FROM lineitem WHERE l_suppkey % 40 <> 5""",
)
def write_listings(spark, d):
    """Writes every slug, then five of them again with changed rows; the others must stay."""
    root = work_path(spark, "maps")
    rows = st.table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_suppkey % 40 AS supplier", "concat('s', CAST(l_suppkey % 40 AS STRING)) AS slug", "l_quantity"
    )
    writers.write_listings(rows, root)
    again = rows.where("supplier < 5").withColumn("l_quantity", F.col("l_quantity") + 1)
    # The sixth was processed again and found nothing, so its old rows must go.
    writers.write_listings(again, root, processed=rows.where("supplier < 6").select("slug"))
    return spark.read.parquet(root).where("supplier IS NOT NULL")


@query(
    "write_query_status",
    f"""WITH s AS ({st.SEARCHES_SQL}) SELECT page_id, CASE WHEN trim(coalesce(query_url, '')) = '' THEN 'pending'
        WHEN lower(trim(coalesce(status, ''))) = 'success' THEN status WHEN page_id % 4 <> 0 THEN 'success' ELSE 'error' END AS status FROM s""",
)
def write_query_status(spark, d):
    """First version: statuses as read. Second: as they came out."""
    root = work_path(spark, "queries")
    writers.write_version(st.searches(spark, d), root)
    writers.write_query_status(outcomes(spark, d), root)
    return writers.read_version(spark, root).select("page_id", "status")


@query("write_combined", MERGED_SQL)
def write_combined(spark, d):
    rows = merge.filter_min_rating(st.parsed_listings(spark, d))
    merged = merge.combined_projection(merge.merge_listings(rows, st.MAP_FILES), st.MAP_FILES)
    path = writers.write_combined(merged, work_path(spark, "combined"), st.MAP_FILES)
    return shown(spark.read.parquet(path))


@query("append_evaluation", "SELECT event_id, event_type, CASE WHEN event_id % 2 = 1 THEN props END AS notes FROM events")
def append_evaluation(spark, d):
    """Two appends; the second brings a column the first lacks."""
    path = work_path(spark, "log")
    log = st.table(spark, d, "events")
    writers.append_evaluations(log.where("event_id % 2 = 0").select("event_id", "event_type"), path)
    writers.append_evaluations(log.where("event_id % 2 = 1").select("event_id", "event_type", F.col("props").alias("notes")), path)
    return writers.read_evaluations(spark, path).select("event_id", "event_type", "notes")


@query(
    "write_back_status",
    f"""WITH l AS ({st.LISTINGS_SQL}), k AS (SELECT DISTINCT trim(listing_link) AS link FROM l WHERE rating >= 4.2 AND trim(coalesce(listing_link, '')) <> '')
    SELECT l_orderkey, l_linenumber, l_suppkey, map_file, listing_link, rating, CASE WHEN k.link IS NULL THEN 'pending' ELSE 'success' END AS status
    FROM l LEFT JOIN k ON trim(l.listing_link) = k.link""",
)
def write_back_status(spark, d):
    root = work_path(spark, "sources")
    columns = ["l_orderkey", "l_linenumber", "l_suppkey", "map_file", "listing_link", "rating", "status"]
    writers.write_version(st.listings(spark, d).select(*columns), root)
    rows = writers.read_version(spark, root)
    writers.write_back_status(merge.mark_included(rows, merge.distinct_links(merge.filter_min_rating(rows))), root)
    return writers.read_version(spark, root).select(*columns)


@query(
    "collect_slugs",
    f"WITH s AS ({_SLUGGED}) SELECT slug, count(*) AS searches FROM s GROUP BY slug",
)
def collect_slugs(spark, d):
    slugs = st.searches(spark, d).select(query_slug(F.col("query_url")).alias("slug"))
    return slugs.groupBy("slug").agg(F.count("*").alias("searches"))
