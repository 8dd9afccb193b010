"""Readers and writers on small tables."""

import pytest
from pyspark.sql import functions as F

from prospectry.operators import evaluations as ev
from prospectry.sources import readers, writers


def test_query_headers(spark):
    rows = spark.createDataFrame([("a", "b", 3)], "Link string, url string, VOLUME int")
    out = readers.normalize_query_headers(rows)
    assert out.columns == ["query_url", "url", "search_volume", "status"] and out.first().status == ""
    with pytest.raises(ValueError):
        readers.normalize_query_headers(spark.range(1))


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_provenance_keeps_row_order(spark, tmp_path, fmt):
    paths = []
    for n in (2, 1):
        path = str(tmp_path / f"list{n}")
        rows = spark.range(50).selectExpr(f"concat('l', id) AS listing_link", "id AS position", "'q' AS source_file").coalesce(1)
        (rows.write.option("header", True) if fmt == "csv" else rows.write).format(fmt).save(path)
        paths.append(path)
    rows = readers.scan_with_provenance(spark, paths, fmt)
    found = rows.orderBy("ord").select("map_file", F.col("position").cast("int").alias("p"), "rating", "source_file").collect()
    assert [(r.map_file, r.p) for r in found] == [(m, i) for m in ("list2", "list1") for i in range(50)]
    assert found[0].rating is None and found[0].source_file == "q"


def test_missing_inputs(spark, tmp_path):
    assert readers.scan_evaluations(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        readers.scan_combined(spark, [str(tmp_path / "none")])


def test_versions_do_not_touch_what_is_read(spark, tmp_path):
    root = str(tmp_path / "t")
    writers.write_version(spark.range(3), root)
    rows = writers.read_version(spark, root)
    writers.write_version(rows.where("id > 0"), root)
    assert (writers.read_version(spark, root).count(), writers.read_version(spark, root, 1).count()) == (2, 3)


def test_guarded_json(spark):
    rows = spark.createDataFrame([(")]}'\n[1,[2]]",), ('{"a": 5}',), ("oops",)], "b string")
    found = rows.select(readers.place_field(F.col("b"), "$[1][0]", "int").alias("x"), readers.place_field(F.col("b"), "$.a", "int").alias("y")).collect()
    assert [(r.x, r.y) for r in found] == [(2, None), (None, 5), (None, None)]


def test_verdicts_reach_their_rows(spark):
    parent = spark.createDataFrame(
        [(0, 0, "a", "pending"), (0, 1, " a ", "pending"), (0, 2, None, "pending"), (1, 0, "a", "pending"), (0, 3, "c", "pending")],
        "file_idx int, row_idx int, listing_link string, status string",
    )
    verdicts = spark.createDataFrame(
        [(0, 1, "a", "good", 1), (0, 2, None, "bad", 2), (0, 3, "gone", "okay", 3), (0, 0, " ", "late", 4)],
        "file_idx int, row_idx int, listing_link string, rating string, seq int",
    )
    found = {(r.file_idx, r.row_idx): r.status for r in ev.apply_evaluations(parent, verdicts).collect()}
    assert found == {(0, 0): "late", (0, 1): "good", (0, 2): "bad", (1, 0): "pending", (0, 3): "okay"}


def test_a_slug_that_finds_nothing_loses_its_rows(spark, tmp_path):
    from prospectry.sources import readers, writers

    root = str(tmp_path / "maps")
    rows = spark.createDataFrame([("s 1", "u1"), ("s 1", "u2"), ("s2", "u3")], "slug string, listing_link string")
    writers.write_listings(rows, root)
    writers.write_listings(rows.limit(0), root, processed=rows.where("slug = 's 1'").select("slug"))
    found = readers.scan_with_provenance(spark, [f"{root}/slug=s 1", f"{root}/slug=s2"])
    assert [(r.map_file, r.listing_link) for r in found.orderBy("map_file").collect()] == [("s 1.xlsx", None), ("s2.xlsx", "u3")]


def test_many_lists_are_one_scan(spark, tmp_path):
    """One scan for hundreds of lists, and no path in what a row carries."""
    root = str(tmp_path / "maps")
    spark.range(900).selectExpr("concat('l', id % 50) AS listing_link", "concat('q', id % 300) AS slug").repartition(1).write.partitionBy("slug").parquet(root)
    paths = [f"{root}/slug=q{i}" for i in reversed(range(300))]
    rows = readers.scan_with_provenance(spark, paths)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert {f.dataType.typeName() for f in rows.schema["ord"].dataType["place"].dataType} == {"integer", "long"}
    found = rows.groupBy("ord.file_idx", "map_file").count().collect()
    assert {(r.file_idx, r.map_file, r["count"]) for r in found} == {(299 - i, f"q{i}.xlsx", 3) for i in range(300)}


def test_lists_of_every_kind(spark, tmp_path):
    """Files beside folders, odd names, folders in folders, a list named twice, other columns, relative paths."""
    import os

    one, odd, deep = str(tmp_path / "one.parquet"), str(tmp_path / "ä b%:c"), str(tmp_path / "deep")
    spark.range(2).selectExpr("'a' AS listing_link", "id AS position").coalesce(1).write.parquet(str(tmp_path / "aside"))
    part = next(p for p in os.listdir(tmp_path / "aside") if p.endswith(".parquet"))
    os.link(tmp_path / "aside" / part, one)
    spark.range(3).selectExpr("'b' AS listing_link", "1.5D AS rating").write.parquet(odd)
    spark.range(4).selectExpr("'c' AS listing_link", "id % 2 AS p").write.partitionBy("p").parquet(deep)
    paths = [deep, one, odd, one, "file://" + str(tmp_path / "aside") + "/"]
    rows = readers.scan_with_provenance(spark, paths)
    found = {(r.file_idx, r.map_file, r.listing_link, r["count"]) for r in rows.groupBy("ord.file_idx", "map_file", "listing_link").count().collect()}
    assert found == {(0, "deep", "c", 4), (1, "one.parquet", "a", 2), (2, "ä b%:c", "b", 3), (3, "one.parquet", "a", 2), (4, "aside", "a", 2)}
    assert rows.select("ord").distinct().count() == 13
    here = os.path.relpath(tmp_path / "aside")
    assert {r.map_file for r in readers.scan_with_provenance(spark, [here]).collect()} == {"aside"}


def test_lists_whose_columns_do_not_fit(spark, tmp_path):
    for name, kind in (("m", "int"), ("n", "string")):
        spark.range(2).selectExpr("'x' AS listing_link", f"CAST(id AS {kind}) AS reviews_count").write.parquet(str(tmp_path / name))
    rows = readers.scan_with_provenance(spark, [str(tmp_path / "n"), str(tmp_path / "m")])
    assert sorted((r.ord.file_idx, str(r.reviews_count)) for r in rows.collect()) == [(0, "0"), (0, "1"), (1, "0"), (1, "1")]
