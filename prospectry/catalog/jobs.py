"""Whole jobs and streams over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectry.catalog import standins as st
from prospectry.catalog.listing_pages import FIELDS
from prospectry.catalog.merging import FILES, MERGED_SQL, shown
from prospectry.catalog.registry import query
from prospectry.catalog.reviewing import _LATEST
from prospectry.functions.lists import parse_categories
from prospectry.plans.chained import run_pipeline
from prospectry.plans.collect import collect_listings
from prospectry.plans.reviewing import review_round, rows_to_review
from prospectry.session import work_path
from prospectry.sources.writers import read_evaluations, write_version
from prospectry.streaming.incremental import current_listings, incremental_listings
from prospectry.streaming.verdicts import apply_current, compact_evaluations, current_evaluations, stream_latest_evaluation

_BOXES = f"""WITH b AS ({st.BOXES_SQL}), s AS ({st.SEARCHES_SQL.replace('SELECT ', f'SELECT {st.SEARCH_SLUG_SQL} AS slug, ', 1)}),
    q AS (SELECT slug, arg_max(page_id, ord) AS page_id FROM s WHERE trim(coalesce(query_url, '')) <> ''
        AND lower(trim(coalesce(status, ''))) <> 'success' AND page_id IN (SELECT p_partkey FROM part) GROUP BY slug)
    SELECT q.slug, q.page_id, b.position, CASE WHEN v % 6 <> 2 AND v % 7 <> 0
        THEN concat('https://maps.example.com/place/', CAST(v AS STRING)) ELSE NULL END AS listing_link, s.search_volume, s.source_file
    FROM q JOIN b ON q.page_id = b.page_id JOIN s ON q.page_id = s.page_id"""


@query("collect_listings", _BOXES)
def collect(spark, d):
    """Pending searches with a captured page, through extraction and panels, to one list per slug."""
    rows, _ = collect_listings(st.searches(spark, d), st.results_pages(spark, d), st.panel_capture(spark, d))
    return rows.select("slug", "page_id", "position", "listing_link", "search_volume", "source_file")


# Every fortieth page shows the same businesses, so that lists share links.
_SHARED = "(p_partkey % 40)"
_CATEGORIES = """CASE WHEN v % 2 = 1 THEN CASE WHEN v % 4 = 1 THEN NULL ELSE 'Roofer|Painter' END
    WHEN v % 5 = 0 THEN concat(p_type, '|', p_brand) ELSE p_type END"""
_FOUND = {n: e for n, e in FIELDS.items() if n not in ("categories", "status")}
_CHAIN = f"""WITH b AS ({st.boxes_sql(_SHARED)}), s AS ({st.SEARCHES_SQL.replace('SELECT ', f'SELECT {st.SEARCH_SLUG_SQL} AS slug, ', 1)}),
    o AS (SELECT *, CASE WHEN trim(coalesce(query_url, '')) = '' THEN 'pending' WHEN lower(trim(coalesce(status, ''))) = 'success' THEN 'success'
        WHEN page_id IN (SELECT p_partkey FROM part) THEN 'success' ELSE 'error' END AS after FROM s),
    q AS (SELECT slug, arg_max(page_id, ord) AS page_id FROM s WHERE trim(coalesce(query_url, '')) <> ''
        AND lower(trim(coalesce(status, ''))) <> 'success' AND page_id IN (SELECT p_partkey FROM part) GROUP BY slug),
    lists AS (SELECT o.slug, o.ord, q.page_id FROM o JOIN q USING (slug) WHERE after = 'success'),
    l AS (SELECT lists.ord, concat(lists.slug, '.xlsx') AS map_file, b.position, {', '.join(f'{e} AS {n}' for n, e in _FOUND.items())},
            {_CATEGORIES} AS categories, s.search_volume, s.source_file
        FROM lists JOIN b ON lists.page_id = b.page_id JOIN s ON lists.page_id = s.page_id),
    k AS (SELECT * FROM l WHERE rating >= 4.2 AND listing_link IS NOT NULL),
    p AS (SELECT *, row_number() OVER (PARTITION BY listing_link, map_file, position ORDER BY ord) AS rn FROM k),
    seen AS (SELECT listing_link, string_agg(CAST(position AS STRING), ',' ORDER BY ord, position) AS positions, string_agg(map_file, ',' ORDER BY ord, position) AS map_files,
        string_agg(coalesce(CAST(search_volume AS STRING), '-'), ',' ORDER BY ord, position) AS search_volumes FROM p WHERE rn = 1 GROUP BY listing_link),
    f AS (SELECT listing_link, {', '.join(f"first({n} ORDER BY ord, position) FILTER (WHERE {n} IS NOT NULL) AS {n}" for n in (*_FOUND, 'categories', 'source_file') if n != 'listing_link')}
        FROM k GROUP BY listing_link)"""


@query(
    "run_pipeline",
    f"""{_CHAIN} SELECT f.listing_link, positions, name, coalesce(categories, '') AS categories, website, phone, address, reviews_count, rating, source_file,
        search_volumes, map_files, 'pending' AS status FROM f JOIN seen USING (listing_link)""",
)
def chained(spark, d):
    """All searches through collection, choice of the lists that exist, and the merge; the merged table is read back."""
    made = run_pipeline(st.searches(spark, d), st.results_pages(spark, d, _SHARED), st.panel_capture(spark, d, _SHARED), work_path(spark, "chain"), flags=False)
    return shown(spark.read.parquet(made.combined))


@query(
    "run_pipeline_sources",
    f"""{_CHAIN} SELECT l.ord AS list, map_file, position, listing_link, CASE WHEN listing_link IN (SELECT listing_link FROM k) THEN 'success' ELSE 'pending' END AS status FROM l""",
)
def chained_sources(spark, d):
    """Rows of the merged lists as the chain writes them back."""
    made = run_pipeline(st.searches(spark, d), st.results_pages(spark, d, _SHARED), st.panel_capture(spark, d, _SHARED), work_path(spark, "chain"), flags=False)
    return spark.read.parquet(made.sources).select(F.col("ord.file_idx").alias("list"), "map_file", "position", "listing_link", "status")


def _arrive_in_four(rows, key, source, run):
    """Rows arrive in four loads, each of as many files as it takes and one batch of the stream that ``run`` starts."""
    for load in range(4):
        rows.where(F.pmod(F.xxhash64(key), F.lit(4)) == load).write.mode("append").parquet(source)
        run(rows.sparkSession.readStream.schema(rows.schema).parquet(source)).awaitTermination()


@query("incremental_listings", MERGED_SQL)
def incremental(spark, d):
    """The flagship merge, fed as a stream of four loads to a store that compacts after every second one."""
    source, root = work_path(spark, "arrivals"), work_path(spark, "stream")

    def merge_load(arrivals):
        parsed = arrivals.withColumn("categories", parse_categories(F.col("categories")))
        return incremental_listings(parsed, FILES, root, 4.2, compact_every=2, slice_rows=20_000)

    _arrive_in_four(st.listings(spark, d), "l_orderkey", source, merge_load)
    return shown(current_listings(st.parsed_listings(spark, d), FILES, root))


@query("stream_latest_evaluation", f"{_LATEST} SELECT * FROM latest")
def stream_latest(spark, d):
    source, root = work_path(spark, "verdicts"), work_path(spark, "stream")
    rows = st.verdicts(spark, d).select("listing_link", "seq", "eval_rating", "eval_time", "notes")
    _arrive_in_four(rows, "seq", source, lambda arrivals: stream_latest_evaluation(arrivals, ["seq"], root))
    return current_evaluations(spark, root, ["seq"])


@query(
    "stream_apply_verdicts",
    f"{_LATEST} SELECT file_idx, row_idx, listing_link, name, coalesce(latest.eval_rating, p.status) AS status FROM p LEFT JOIN latest ON trim(p.listing_link) = latest.link",
)
def stream_apply(spark, d):
    """Verdicts arrive in two runs with a compaction in between, then reach the merged table."""
    source, root = work_path(spark, "verdicts"), work_path(spark, "stream")
    rows = st.verdicts(spark, d).select("listing_link", "seq", "eval_rating", "eval_time", "notes")
    for part in range(2):
        rows.where(F.col("seq") % 2 == part).write.mode("append").parquet(source)
        stream_latest_evaluation(spark.readStream.schema(rows.schema).parquet(source), ["seq"], root).awaitTermination()
        if part == 0:
            compact_evaluations(spark, root, ["seq"])
    return apply_current(st.merged_parent(spark, d), current_evaluations(spark, root, ["seq"]))


_ROUNDS = f"""WITH v AS ({st.VERDICTS_SQL}), p AS ({st.PARENT_SQL}),
    e1 AS (SELECT row_idx, arg_max(eval_rating, seq) AS rating, arg_max(notes, seq) AS notes FROM v WHERE seq % 2 = 0 GROUP BY row_idx),
    one AS (SELECT p.*, e1.rating AS r1, e1.notes AS n1, coalesce(e1.rating, p.status) AS s1 FROM p LEFT JOIN e1 USING (row_idx)),
    e2 AS (SELECT row_idx, arg_max(eval_rating, seq) AS rating, arg_max(notes, seq) AS notes FROM v WHERE seq % 2 = 1 GROUP BY row_idx),
    two AS (SELECT one.*, e2.rating AS r2, e2.notes AS n2, coalesce(e2.rating, s1) AS s2 FROM one LEFT JOIN e2
        ON one.row_idx = e2.row_idx AND lower(trim(s1)) = 'pending')"""


def _reviewed(spark, d):
    """Two rounds of review over three merged tables; the second one looks at pending rows only."""
    root, order = work_path(spark, "review"), ["round", "seq"]
    tables = [f"{root}/table{i}" for i in range(3)]
    parent = st.merged_parent(spark, d)
    for i, path in enumerate(tables):
        write_version(parent.where(F.col("file_idx") == i).select(F.col("row_idx").alias("row_id"), "listing_link", "name", "status"), path)
    verdicts = st.verdicts(spark, d).drop("listing_link")
    for number, status in ((1, None), (2, "Pending ")):
        given = verdicts.where(F.col("seq") % 2 == number - 1).withColumn("round", F.lit(number).cast("long"))
        review_round(spark, tables, f"{root}/log", given, order, status)
    return tables, read_evaluations(spark, f"{root}/log"), order


@query(
    "review_round",
    f"""{_ROUNDS} SELECT file_idx, row_idx, listing_link, name, s2 AS status,
        CASE WHEN trim(coalesce(listing_link, '')) = '' THEN lower(trim(s2)) ELSE coalesce(nullif(lower(trim(coalesce(r2, r1))), ''), lower(trim(s2))) END AS rating_tag,
        CASE WHEN trim(coalesce(listing_link, '')) = '' THEN '' ELSE coalesce(trim(n2), trim(n1), '') END AS notes FROM two""",
)
def reviewed(spark, d):
    """The merged tables as the next reviewer sees them."""
    tables, log, order = _reviewed(spark, d)
    return rows_to_review(spark, tables, log, order).select("file_idx", "row_idx", "listing_link", "name", "status", "rating_tag", "notes")


@query(
    "review_log",
    f"""{_ROUNDS} SELECT v.seq, v.row_idx, two.name, v.eval_rating, date_trunc('second', v.eval_time) AS eval_time, trim(coalesce(v.notes, '')) AS notes,
        CASE WHEN v.seq % 2 = 0 THEN two.status ELSE s1 END AS status
    FROM v JOIN two ON v.row_idx = two.row_idx WHERE v.seq % 2 = 0 OR lower(trim(s1)) = 'pending'""",
)
def review_log(spark, d):
    """The log of both rounds: each verdict with the whole row as it was shown."""
    return _reviewed(spark, d)[1].select("seq", "row_idx", "name", "eval_rating", "eval_time", "notes", "status")
