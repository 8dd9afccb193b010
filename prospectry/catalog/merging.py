"""Merge queries: lineitem rows as appearances of businesses in six result lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectry.catalog import standins as st
from prospectry.catalog.registry import query
from prospectry.functions.lists import dedupe_ci_ordered
from prospectry.operators import merge
from prospectry.plans.merging import merge_lists

FILES = st.MAP_FILES
_ORDER = ", ".join(st.ORDER)
_VALID = "trim(coalesce(listing_link, '')) <> ''"
_ROWS = f"WITH l AS ({st.LISTINGS_SQL})"
_KEPT = f"{_ROWS}, k AS (SELECT * FROM l WHERE rating >= 4.2)"

# Items of a categories cell, from the way the stand-in spells it.
_CATEGORIES = """CASE WHEN l_linenumber IN (2, 3, 4, 5)
    THEN concat('Type ', CAST(l_suppkey % 5 AS STRING), '|Brand ', CAST(l_partkey % 25 AS STRING)) ELSE NULL END"""


def _first(column: str) -> str:
    """Earliest known value."""
    known = f"{column} IS NOT NULL"
    if column in ("name", "website", "phone", "address", "source_file"):
        known = f"trim(coalesce({column}, '')) <> ''"
    return f"first({column} ORDER BY {_ORDER}) FILTER (WHERE {known})"


_FLAGS = ", ".join(f"bool_or(map_file = '{f}') AS query_filename{i}" for i, f in enumerate(FILES, 1))

MERGED_SQL = f"""{_KEPT},
pairs AS (
    SELECT listing_link, map_file, CAST(position AS INT) AS position,
        row_number() OVER (PARTITION BY listing_link, map_file, position ORDER BY {_ORDER}) AS rn,
        search_volume, {_ORDER}
    FROM k WHERE {_VALID} AND position IS NOT NULL AND position <> '6.0'
),
seen AS (
    SELECT listing_link, string_agg(CAST(position AS STRING), ',' ORDER BY {_ORDER}) AS positions,
        string_agg(map_file, ',' ORDER BY {_ORDER}) AS map_files,
        string_agg(coalesce(CAST(search_volume AS STRING), '-'), ',' ORDER BY {_ORDER}) AS search_volumes
    FROM pairs WHERE rn = 1 GROUP BY listing_link
),
fields AS (
    SELECT listing_link, {_first('name')} AS name, first({_CATEGORIES} ORDER BY {_ORDER}) FILTER (WHERE {_CATEGORIES} IS NOT NULL) AS categories,
        {_first('website')} AS website, {_first('phone')} AS phone, {_first('address')} AS address,
        {_first('reviews_count')} AS reviews_count, {_first('rating')} AS rating, {_first('source_file')} AS source_file,
        {_FLAGS}
    FROM k WHERE {_VALID} GROUP BY listing_link
)
SELECT f.listing_link, coalesce(s.positions, '') AS positions, f.name, coalesce(f.categories, '') AS categories, f.website, f.phone, f.address,
    f.reviews_count, f.rating, f.source_file, coalesce(s.search_volumes, '') AS search_volumes,
    coalesce(s.map_files, '') AS map_files, 'pending' AS status,
    {', '.join(f'f.query_filename{i}' for i in range(1, len(FILES) + 1))}
FROM fields f LEFT JOIN seen s ON f.listing_link = s.listing_link"""


def _text(arrays: str, missing: str = "") -> F.Column:
    return F.array_join(F.transform(arrays, lambda x: x.cast("string")), ",", missing or None)


def shown(merged):
    """Arrays as text, so that both engines compare plain values."""
    flags = [c for c in merged.columns if c.startswith("query_filename")]
    return merged.select(
        "listing_link", _text("position").alias("positions"), "name",
        F.array_join("categories", "|").alias("categories"), "website", "phone", "address",
        "reviews_count", "rating", "source_file", _text("search_volume", "-").alias("search_volumes"),
        _text("map_files").alias("map_files"), "status", *flags,
    )


def _kept(spark, d):
    return merge.filter_min_rating(st.parsed_listings(spark, d))


@query("merge_listings", MERGED_SQL)
def merge_listings(spark, d):
    return shown(merge.merge_listings(_kept(spark, d), FILES))


@query("combined_projection", MERGED_SQL)
def combined_projection(spark, d):
    return shown(merge_lists(st.listings(spark, d), FILES).combined)


@query(
    "merge_appearances",
    f"""{_KEPT}, p AS (
        SELECT listing_link, map_file, CAST(position AS INT) AS position, search_volume, l_orderkey,
            row_number() OVER (PARTITION BY listing_link, map_file, position ORDER BY {_ORDER}) AS rn
        FROM k WHERE {_VALID} AND position IS NOT NULL AND position <> '6.0')
    SELECT listing_link, map_file, position, search_volume, l_orderkey AS first_row FROM p WHERE rn = 1""",
)
def merge_appearances(spark, d):
    seen = merge.merge_appearances(_kept(spark, d))
    return seen.select("listing_link", "map_file", "position", "search_volume", F.col("ord.l_orderkey").alias("first_row"))


@query(
    "merge_listings_long",
    f"""{_KEPT}, p AS (
        SELECT listing_link, map_file, CAST(position AS INT) AS position, search_volume, {_ORDER},
            row_number() OVER (PARTITION BY listing_link, map_file, position ORDER BY {_ORDER}) AS rn
        FROM k WHERE {_VALID} AND position IS NOT NULL AND position <> '6.0'),
    n AS (SELECT *, (row_number() OVER (PARTITION BY listing_link ORDER BY {_ORDER}) - 1) // 3 AS chunk FROM p WHERE rn = 1),
    c AS (SELECT listing_link, chunk, string_agg(CAST(position AS STRING), ',' ORDER BY {_ORDER}) AS positions, string_agg(map_file, ',' ORDER BY {_ORDER}) AS map_files,
        string_agg(coalesce(CAST(search_volume AS STRING), '-'), ',' ORDER BY {_ORDER}) AS search_volumes FROM n GROUP BY 1, 2),
    f AS (SELECT listing_link, {_first('name')} AS name, {_first('rating')} AS rating FROM k WHERE {_VALID} GROUP BY listing_link)
    SELECT listing_link, coalesce(chunk, 0) AS chunk, name, rating, coalesce(positions, '') AS positions, coalesce(map_files, '') AS map_files,
        coalesce(search_volumes, '') AS search_volumes FROM f LEFT JOIN c USING (listing_link)""",
)
def merge_listings_long(spark, d):
    """Appearances in numbered chunks of three, so that most links have several."""
    long = merge.merge_listings_long(_kept(spark, d), chunk=3)
    return long.select(
        "listing_link", "chunk", "name", "rating", _text("position").alias("positions"), _text("map_files").alias("map_files"), _text("search_volume", "-").alias("search_volumes")
    )


@query("filter_min_rating", f"{_ROWS} SELECT listing_link, map_file, l_orderkey, rating FROM l WHERE rating >= 4.2")
def filter_min_rating(spark, d):
    return merge.filter_min_rating(st.listings(spark, d)).select("listing_link", "map_file", "l_orderkey", "rating")


@query("valid_link", f"{_ROWS} SELECT listing_link, l_orderkey, l_linenumber FROM l WHERE {_VALID}")
def valid_link(spark, d):
    rows = st.listings(spark, d)
    return rows.where(merge.valid_link(F.col("listing_link"))).select("listing_link", "l_orderkey", "l_linenumber")


# The literal text "nan" stands for a missing link in old tables.
_NAN_LINK = "CASE WHEN l_linenumber = 4 THEN ' NaN ' ELSE listing_link END"


@query(
    "valid_link_text",
    f"""{_ROWS}, n AS (SELECT {_NAN_LINK} AS link, l_orderkey FROM l)
    SELECT trim(link) AS link, l_orderkey FROM n WHERE trim(coalesce(link, '')) <> '' AND lower(trim(link)) <> 'nan'""",
)
def valid_link_text(spark, d):
    rows = st.listings(spark, d).withColumn("link", F.expr(_NAN_LINK))
    return rows.where(merge.valid_link_text(F.col("link"))).select(F.trim("link").alias("link"), "l_orderkey")


@query(
    "dedup_summary",
    f"""{_ROWS} SELECT count(*) AS rows_before, count(*) FILTER (WHERE NOT coalesce(rating >= 4.2, false)) AS removed_by_rating,
        count(*) FILTER (WHERE rating >= 4.2 AND NOT ({_VALID})) AS removed_no_link,
        count(*) FILTER (WHERE rating >= 4.2 AND {_VALID})
            - count(DISTINCT CASE WHEN rating >= 4.2 AND {_VALID} THEN trim(listing_link) END) AS removed_by_dedup,
        count(DISTINCT CASE WHEN rating >= 4.2 AND {_VALID} THEN listing_link END) AS rows_out FROM l""",
)
def dedup_summary(spark, d):
    return merge.dedup_summary(st.listings(spark, d))


@query("source_flags", f"{_KEPT} SELECT listing_link, {_FLAGS} FROM k WHERE {_VALID} GROUP BY listing_link")
def source_flags(spark, d):
    return merge.source_flags(merge.filter_min_rating(st.listings(spark, d)), FILES)


@query("distinct_links", f"{_KEPT} SELECT DISTINCT trim(listing_link) AS link FROM k WHERE {_VALID}")
def distinct_links(spark, d):
    return merge.distinct_links(merge.filter_min_rating(st.listings(spark, d)))


@query(
    "mark_included",
    f"""{_KEPT}, s AS (SELECT DISTINCT trim(listing_link) AS link FROM k WHERE {_VALID})
    SELECT l.listing_link, l.map_file, l.l_orderkey, l.l_linenumber,
        CASE WHEN s.link IS NULL THEN 'pending' ELSE 'success' END AS status
    FROM l LEFT JOIN s ON trim(l.listing_link) = s.link""",
)
def mark_included(spark, d):
    return merge_lists(st.listings(spark, d), FILES).sources.select(
        "listing_link", "map_file", "l_orderkey", "l_linenumber", "status"
    )


@query(
    "included_excluded_rows",
    f"""{_KEPT}, s AS (SELECT DISTINCT trim(listing_link) AS link FROM k WHERE {_VALID}),
    j AS (SELECT l.map_file, s.link FROM l LEFT JOIN s ON trim(l.listing_link) = s.link)
    SELECT map_file, count(link) AS included, count(*) - count(link) AS excluded FROM j GROUP BY map_file""",
)
def included_excluded_rows(spark, d):
    rows = st.listings(spark, d)
    links = merge.distinct_links(merge.filter_min_rating(rows))
    sides = merge.included_rows(rows, links).select("map_file", F.lit(1).alias("side")).unionByName(
        merge.excluded_rows(rows, links).select("map_file", F.lit(0).alias("side"))
    )
    return sides.groupBy("map_file").agg(
        F.count_if(F.col("side") == 1).alias("included"), F.count_if(F.col("side") == 0).alias("excluded")
    )


@query(
    "source_index",
    f"{_ROWS} SELECT map_file, file_idx AS source_index, count(*) AS listings FROM l GROUP BY map_file, file_idx",
)
def source_index(spark, d):
    names = F.array(*[F.lit(f) for f in FILES])
    # Count first: the index is looked up once per list, not once per row.
    counts = st.listings(spark, d).groupBy("map_file").agg(F.count("*").alias("listings"))
    return counts.select("map_file", F.array_position(names, F.col("map_file")).cast("int").alias("source_index"), "listings")


@query(
    "encounter_order",
    f"""{_ROWS}, r AS (SELECT listing_link, file_idx, l_orderkey, l_linenumber,
        row_number() OVER (PARTITION BY listing_link ORDER BY {_ORDER}) AS rn FROM l WHERE {_VALID})
    SELECT listing_link, file_idx AS first_list, l_orderkey AS first_order, l_linenumber AS first_line FROM r WHERE rn = 1""",
)
def encounter_order(spark, d):
    rows = st.listings(spark, d).where(merge.valid_link(F.col("listing_link")))
    first = rows.groupBy("listing_link").agg(F.min("ord").alias("o"))
    return first.select(
        "listing_link", F.col("o.file_idx").alias("first_list"), F.col("o.l_orderkey").alias("first_order"),
        F.col("o.l_linenumber").alias("first_line"),
    )


@query(
    "keep_encounter_order",
    f"""{MERGED_SQL.rsplit('SELECT f.listing_link', 1)[0].rstrip()}
    SELECT listing_link, positions, map_files FROM seen""",
)
def keep_encounter_order(spark, d):
    merged = merge.merge_listings(_kept(spark, d), FILES).where(F.size("position") > 0)
    return merged.select("listing_link", _text("position").alias("positions"), _text("map_files").alias("map_files"))


@query(
    "union_listings",
    f"""{_ROWS} SELECT map_file, listing_link, rating, CASE WHEN file_idx > 3 THEN phone ELSE NULL END AS phone FROM l""",
)
def union_listings(spark, d):
    rows = st.listings(spark, d)
    early = rows.where("file_idx <= 3").select("map_file", "listing_link", "rating")
    late = rows.where("file_idx > 3").select("rating", "phone", "map_file", "listing_link")
    return merge.union_listings([early, late])


@query(
    "dedupe_ci_ordered",
    """SELECT l_orderkey, l_linenumber, concat(l_returnflag, CASE WHEN lower(l_linestatus) <> lower(l_returnflag)
        THEN concat(',', l_linestatus) ELSE '' END) AS kept FROM lineitem""",
)
def dedupe_ci_ordered_query(spark, d):
    items = F.array(
        F.col("l_returnflag"), F.lit(" "), F.lower("l_returnflag"), F.concat(F.lit(" "), "l_linestatus"),
        F.lower("l_linestatus"), F.col("l_returnflag"), F.lit(None),
    )
    return st.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array_join(dedupe_ci_ordered(items), ",").alias("kept")
    )
