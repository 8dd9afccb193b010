"""The chained job: from a query list and captured pages to one merged table."""

from pyspark.sql import functions as F

from prospectry.catalog import standins as st
from prospectry.operators import merge
from prospectry.plans.chained import available_lists, read_lists, run_pipeline
from prospectry.sources import writers


def _inputs(spark, sf):
    return st.searches(spark, sf), st.results_pages(spark, sf, "(p_partkey % 7)"), st.panel_capture(spark, sf, "(p_partkey % 7)")


def test_a_second_run_goes_on_from_the_first(spark, sf, tmp_path):
    queries, pages, panels = _inputs(spark, sf)
    root = str(tmp_path / "chain")
    first = run_pipeline(queries, pages.where("page_id % 2 = 0"), panels, root, flags=False)
    saved = writers.read_version(spark, f"{root}/queries")
    second = run_pipeline(saved, pages, panels, root, flags=False)
    assert (first.status, second.status) == (0, 0)
    assert len(second.files) > len(first.files) and set(first.files) <= set(second.files)
    again = writers.read_version(spark, f"{root}/queries")
    assert again.where("status = 'success'").count() > saved.where("status = 'success'").count()
    # Lists of the first run are merged again, though their queries are done.
    links = lambda made: {r[0] for r in spark.read.parquet(made.combined).select("listing_link").collect()}
    assert links(first) <= links(second)
    assert second.summary.first().rows_before == spark.read.parquet(second.sources).count()


def test_nothing_to_merge(spark, sf, tmp_path):
    queries, pages, panels = _inputs(spark, sf)
    made = run_pipeline(queries, pages.limit(0), panels, str(tmp_path / "chain"))
    assert (made.status, made.files, made.combined) == (1, [], None)


def test_flags_and_repeats(spark, tmp_path):
    """Two finished queries with one slug name their list twice; odd letters of a slug find their folder."""
    queries = spark.createDataFrame(
        [(1, "https://maps.example.com/maps?q=50%25+%2B+a:b", None, 1.0, "q", 1), (2, "https://maps.example.com/maps?q=other", "error", 2.0, "q", 2),
         (3, "https://maps.example.com/maps?q=50%25+%2B+a:b", "", 3.0, "q", 3), (4, "https://maps.example.com/maps?q=gone", "", 4.0, "q", 4)],
        "page_id long, query_url string, status string, search_volume double, source_file string, ord int",
    )
    box = lambda v: f'<div class="Nv2PK"><a class="hfpxzc" aria-label="B{v}" href="https://maps.example.com/place/{v}"></a><span class="ZkP5Je" aria-label="stars"><span class="MW4etd">4.5</span></span></div>'
    pages = spark.createDataFrame([(1, box(1)), (2, box(1) + box(2)), (3, box(1) + box(3))], "page_id long, html string")
    panels = spark.createDataFrame([], "page_id long, position int, panel_html string, image_src string")
    made = run_pipeline(queries, pages, panels, str(tmp_path / "chain"))
    assert len(made.files) == 3 and made.files[0] == made.files[2] != made.files[1]
    found = {r.listing_link[-1]: (r.map_files, r.position, r.query_filename1, r.query_filename2, r.query_filename3) for r in spark.read.parquet(made.combined).collect()}
    odd, other = made.files[:2]
    assert found == {"1": ([odd, other], [1, 1], False, True, True), "2": ([other], [2], False, True, False), "3": ([odd], [2], False, False, True)}
    assert spark.read.parquet(made.sources).count() == 6
    assert available_lists(spark, str(tmp_path / "chain/maps")).count() == 2


def test_one_scan_for_all_lists(spark, tmp_path):
    root = str(tmp_path / "maps")
    rows = spark.range(600).selectExpr("concat('l', id % 50) AS listing_link", "CAST(id AS int) AS position", "4.5D AS rating", "concat('q', id % 100) AS slug")
    writers.write_listings(rows, root)
    available = available_lists(spark, root)
    assert available.count() == 100
    assert "content" not in available._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    lists = available.withColumn("ord", F.xxhash64("slug"))
    plan = read_lists(spark, root, lists, rows.schema)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_long_form_equals_the_arrays(spark, sf):
    rows = merge.filter_min_rating(st.parsed_listings(spark, sf))
    whole = {r.listing_link: r for r in merge.merge_listings(rows, st.MAP_FILES).collect()}
    for chunk in (1, 4, 1000):
        found = {}
        for r in merge.merge_listings_long(rows, chunk).orderBy("listing_link", "chunk").collect():
            assert len(r.position) <= chunk and r.name == whole[r.listing_link].name
            found.setdefault(r.listing_link, []).extend(zip(r.position, r.map_files, r.search_volume))
        assert found == {k: list(zip(r.position, r.map_files, r.search_volume)) for k, r in whole.items()}


def test_hot_link_over_many_lists(spark, tmp_path):
    """A link on every page of 10,000 lists is written in chunks, whole and in order."""
    rows = spark.range(60_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('l', id % 500) END AS listing_link", "concat('m', id div 6) AS map_file", "CAST(id % 6 AS string) AS position",
        "concat('n', id) AS name", "array('c') AS categories", "'w' AS website", "'p' AS phone", "'a' AS address", "1 AS reviews_count", "4.5D AS rating",
        "'s' AS source_file", "CAST(id AS double) AS search_volume", "struct(CAST(id div 6 AS int) AS f, id) AS ord",
    )
    path = str(tmp_path / "long")
    merge.merge_listings_long(rows, 1000).write.parquet(path)
    hot = spark.read.parquet(path).where("listing_link = 'hot'").orderBy("chunk").collect()
    assert [len(r.position) for r in hot] == [1000] * 20
    assert [v for r in hot for v in r.search_volume] == [float(i) for i in range(0, 60_000, 3)]
    assert {r.name for r in hot} == {"n0"}


def test_long_form_of_ranks_without_a_list(spark):
    schema = "listing_link string, map_file string, position string, search_volume double, list int, row int"
    rows = [("a", None, "3", 7.0, 1, 0), ("a", "m1", "4", 7.0, 1, 1), ("a", " ", "4", 7.0, 1, 2), ("a", "m2", "3", 7.0, 2, 0), ("b", None, None, 1.0, 1, 3)]
    more = {n: F.lit(None).cast("string") for n in ("name", "website", "phone", "address", "source_file")}
    more |= {"rating": F.lit(5.0), "reviews_count": F.lit(1), "categories": F.array().cast("array<string>")}
    df = spark.createDataFrame(rows, schema).withColumns(more).withColumn("ord", F.struct("list", "row"))
    whole = {r.listing_link: (r.position, r.map_files, r.search_volume) for r in merge.merge_listings(df, ["m1", "m2"]).collect()}
    long = {r.listing_link: (r.position, r.map_files, r.search_volume) for r in merge.merge_listings_long(df).collect()}
    assert whole == long == {"a": ([3, 4, 3], [None, "m1", "m2"], [None, 7.0, 7.0]), "b": ([], [], [])}


def test_many_lists_are_few_files(spark, tmp_path):
    """The chain keeps its lists in one table; lists written again lose their old rows, others stay, folders of old are taken in."""
    root = str(tmp_path / "maps")
    rows = spark.range(600).selectExpr("concat('l', id) AS listing_link", "CAST(id AS int) AS position", "concat('q', id % 300) AS slug")
    writers.write_listings(rows.where("id % 300 < 10"), root)
    writers.write_listings(rows.where("id % 300 >= 5").withColumn("position", F.lit(7)), root, folders=False)
    writers.write_listings(rows.where("slug = 'q299'").limit(1), root, folders=False)
    assert len([p for p in (tmp_path / "maps").rglob("*.parquet") if "slug=" not in str(p)]) < 50
    found = {r.slug: (r.n, r.p) for r in writers.read_listings(spark, root, rows.schema).groupBy("slug").agg(F.count("*").alias("n"), F.max("position").alias("p")).collect()}
    assert found == {f"q{i}": (2, 300 + i) if i < 5 else (2, 7) if i < 299 else (1, 299) for i in range(300)}
    assert available_lists(spark, root).count() == 300
