"""Shape of the plans that matter at scale."""

from pyspark.sql import functions as F

from prospectry.catalog import standins as st
from prospectry.catalog.all import QUERIES
from prospectry.operators import merge, site


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merge_has_two_shuffles_with_partial_steps(spark, sf):
    plan = _plan(QUERIES["merge_listings"](spark, sf))
    assert plan.count("Exchange hashpartitioning") == 2
    assert "partial_min" in plan and "partial_collect_list" in plan
    assert "BroadcastExchange" not in plan and "Window" not in plan and "Python" not in plan


def test_rating_filter_reaches_the_scan(spark, sf, tmp_path):
    path = str(tmp_path / "listings")
    st.listings(spark, sf).drop("ord").write.parquet(path)
    rows = merge.filter_min_rating(spark.read.parquet(path)).select("listing_link")
    plan = _plan(rows)
    assert "GreaterThanOrEqual(rating,4.2)" in plan
    assert "ReadSchema: struct<listing_link:string,rating:double>" in plan


def test_latest_verdict_needs_no_window(spark, sf):
    plan = _plan(QUERIES["latest_evaluation"](spark, sf))
    assert "Window" not in plan and plan.count("Exchange") == 1 and "partial_max" in plan


def test_python_runs_only_where_pages_are_read(spark, sf):
    reads_pages = {
        n for n in QUERIES
        if n not in ("incremental_listings", "stream_latest_evaluation", "stream_apply_verdicts", "is_responsive", "site_profile", "profile_and_score")
        and not n.startswith(("write", "append", "scan_combined"))
        and "MapInArrow" in _plan(QUERIES[n](spark, sf))
    }
    assert {"merge_listings", "score_sum", "has_favicon", "is_html5", "detect_site_builder", "check_sitemap"}.isdisjoint(reads_pages)
    assert {"extract_listings", "extract_panels", "page_features"} <= reads_pages


def test_source_only_signals_skip_the_parser(spark, sf):
    plan = _plan(st.site_pages(spark, sf).select(site.has_favicon(F.col("html")), site.is_html5(F.col("html"))))
    assert "MapInArrow" not in plan and "url" not in plan.split("ReadSchema")[1]


def test_no_query_uses_a_cross_join(spark, sf):
    for name in ("mark_included", "attach_latest_eval", "apply_eval_to_parent", "check_sitemap", "category_histogram", "expected_outputs"):
        plan = _plan(QUERIES[name](spark, sf))
        assert "Cartesian" not in plan and "NestedLoop" not in plan, name


def test_only_pages_of_chosen_queries_are_parsed(spark, sf):
    plan = _plan(QUERIES["collect_listings"](spark, sf))
    for part in plan.split("MapInArrow")[1:]:
        assert "LeftSemi" in part


def test_histogram_scans_once(spark, sf):
    plan = _plan(QUERIES["category_histogram"](spark, sf))
    assert plan.count("FileScan parquet") == 1


def test_profile_moves_wide_rows_once(spark, sf):
    """Every wide exchange is on page_id; by domain only narrow rows move, and no HTML leaves the parser."""
    plan = _plan(QUERIES["site_profile"](spark, sf))
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("page_id" in e or "url" in e or "domain" in e for e in exchanges)
    for part in plan.split("Exchange hashpartitioning(domain")[1:]:
        child = part.splitlines()[1]
        assert "framework" not in child and "genericTitle" not in child
    for line in plan.splitlines():
        if "MapInArrow" in line:
            assert "html#" not in line.rsplit("[", 1)[1]


def test_source_goes_into_the_parser_once(spark, sf):
    from prospectry.operators import profile

    plan = _plan(profile.page_signals(st.site_pages(spark, sf)))
    parsed = next(line for line in plan.splitlines() if "MapInArrow" in line)
    assert "html" not in parsed.rsplit("[", 1)[1] and "source" in parsed


def test_stored_pages_give_many_tasks(spark, tmp_path):
    from prospectry.sources import writers

    pages = spark.range(1000).coalesce(1).selectExpr("id AS page_id", "repeat('<p>word</p>', 200) AS html")
    stored = writers.write_pages(pages, str(tmp_path / "pages"), file_bytes=200_000)
    assert len(stored.inputFiles()) >= 10 and stored.count() == 1000 and stored.dtypes == pages.dtypes
    empty = writers.write_pages(pages.limit(0), str(tmp_path / "none"))
    assert empty.count() == 0
