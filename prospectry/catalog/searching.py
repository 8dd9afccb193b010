"""Query-list queries: orders as searches in five query tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectry.catalog import standins as st
from prospectry.catalog.registry import query
from prospectry.functions.text import normalize_status
from prospectry.functions.urls import query_slug
from prospectry.operators import searches
from prospectry.sources.readers import normalize_query_headers

_ROWS = f"WITH s AS ({st.SEARCHES_SQL.replace('SELECT ', f'SELECT o_orderkey, {st.SEARCH_SLUG_SQL} AS slug, ', 1)})"
_STATUS = "lower(trim(coalesce(status, '')))"
_BLANK = "trim(coalesce(query_url, '')) = ''"


@query("normalize_status", f"{_ROWS} SELECT page_id, {_STATUS} AS status FROM s")
def normalize_status_query(spark, d):
    return st.searches(spark, d).select("page_id", normalize_status(F.col("status")).alias("status"))


@query(
    "select_pending",
    f"{_ROWS} SELECT page_id, query_url, 'pending/error/empty' AS reason FROM s WHERE NOT {_BLANK} AND {_STATUS} <> 'success'",
)
def select_pending(spark, d):
    return searches.select_pending(st.searches(spark, d)).select("page_id", "query_url", "reason")


@query("select_pending_again", f"{_ROWS} SELECT page_id, 'rescrape' AS reason FROM s WHERE NOT {_BLANK}")
def select_pending_again(spark, d):
    return searches.select_pending(st.searches(spark, d), redo=True).select("page_id", "reason")


@query("blank_url_pending", f"{_ROWS} SELECT page_id, CASE WHEN {_BLANK} THEN 'pending' ELSE status END AS status FROM s")
def blank_url_pending(spark, d):
    return searches.blank_url_pending(st.searches(spark, d)).select("page_id", "status")


@query(
    "attach_search_volume",
    f"""{_ROWS} SELECT l_orderkey, l_linenumber, l_partkey, s.search_volume FROM lineitem LEFT JOIN s ON l_orderkey = s.page_id""",
)
def attach_search_volume(spark, d):
    found = st.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), "l_linenumber", "l_partkey", F.lit(0).alias("search_volume"))
    out = searches.attach_search_volume(found, st.searches(spark, d), ["page_id"])
    return out.withColumnRenamed("page_id", "l_orderkey")


# A search has a captured page when its number is not a multiple of four.
_OUTCOME = f"CASE WHEN {_BLANK} THEN 'pending' WHEN {_STATUS} = 'success' THEN 'skipped' WHEN page_id % 4 <> 0 THEN 'success' ELSE 'error' END"


def outcomes(spark, d):
    rows = st.searches(spark, d)
    return searches.query_outcomes(rows, rows.where("page_id % 4 <> 0").select("page_id"), False, ["page_id"])


@query(
    "scrape_summary",
    f"""{_ROWS}, o AS (SELECT source_file, {_OUTCOME} AS outcome FROM s)
    SELECT source_file, {', '.join(f"count(*) FILTER (WHERE outcome = '{k}') AS {k}" for k in ('success', 'error', 'pending', 'skipped'))}
    FROM o GROUP BY source_file""",
)
def scrape_summary(spark, d):
    return searches.scrape_summary(outcomes(spark, d), "source_file")


_NO_SUCCESS = "CASE WHEN source_file = 'queries_3.parquet' AND trim(lower(status)) = 'success' THEN 'pending' ELSE status END"
_EXPECTED = f"""{_ROWS}, q AS (SELECT page_id, source_file, query_url, slug, {_NO_SUCCESS} AS status FROM s),
    f AS (SELECT *, bool_or({_STATUS} = 'success') OVER (PARTITION BY source_file) AS any_done FROM q),
    e AS (SELECT source_file, page_id, concat(slug, '.xlsx') AS map_file FROM f
        WHERE CASE WHEN any_done THEN {_STATUS} = 'success' ELSE NOT {_BLANK} END)"""


def _expected(spark, d):
    rows = st.searches(spark, d).withColumn("status", F.expr(_NO_SUCCESS))
    return searches.expected_outputs(rows, "source_file").select("source_file", "page_id", "map_file")


@query("expected_outputs", f"{_EXPECTED} SELECT * FROM e")
def expected_outputs(spark, d):
    return _expected(spark, d)


@query(
    "existing_outputs",
    f"{_EXPECTED} SELECT * FROM e WHERE map_file IN (SELECT concat('roof_repair_', CAST(c_custkey AS STRING), '.xlsx') FROM customer WHERE c_nationkey < 12)",
)
def existing_outputs(spark, d):
    made = st.table(spark, d, "customer").where("c_nationkey < 12")
    return searches.existing_outputs(_expected(spark, d), made.selectExpr("concat('roof_repair_', CAST(c_custkey AS STRING), '.xlsx') AS map_file"))


@query(
    "last_query_per_slug",
    f"{_ROWS} SELECT slug, max(page_id) AS page_id FROM s GROUP BY slug",
)
def last_query_per_slug(spark, d):
    rows = st.searches(spark, d)
    slugged = rows.select("ord", "page_id", query_slug(F.col("query_url")).alias("slug"))
    return searches.last_query_per_slug(slugged).select("slug", "page_id")


@query(
    "query_headers",
    "SELECT o_orderkey, o_orderpriority AS query_url, '' AS status, o_totalprice AS search_volume FROM orders",
)
def query_headers(spark, d):
    rows = st.table(spark, d, "orders").selectExpr("o_orderkey", "o_orderpriority AS ` Link`", "o_totalprice AS `Search Volume `")
    return normalize_query_headers(rows)
