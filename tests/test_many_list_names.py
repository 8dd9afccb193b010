"""The chain does not bring the names of many lists to the driver."""

import pytest
from pyspark.sql import DataFrame, functions as F

from prospectry.plans import chained

BOX = """<div class="Nv2PK"><a class="hfpxzc" aria-label="B" href="https://maps.example.com/place/{0}"></a>
    <span class="ZkP5Je" aria-label="stars"><span class="MW4etd">4.5</span></span></div>"""


def made_by(spark, root, n=60):
    queries = spark.range(n).select(
        F.col("id").alias("page_id"), F.concat(F.lit("https://maps.example.com/maps?q=q"), F.col("id") % 45).alias("query_url"), F.lit(None).cast("string").alias("status"),
        F.lit(1.0).alias("search_volume"), F.lit("q").alias("source_file"), F.col("id").alias("ord"),
    )
    before, after = BOX.split("{0}")
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit(before), F.col("id") % 7, F.lit(after)).alias("html"))
    panels = spark.createDataFrame([], "page_id long, position int, panel_html string, image_src string")
    return chained.run_pipeline(queries, pages, panels, root, flags=False)


def merged_rows(spark, made):
    return sorted((r.listing_link, tuple(r.map_files), tuple(r.position)) for r in spark.read.parquet(made.combined).collect())


def test_names_stay_in_their_table(spark, tmp_path, monkeypatch):
    few = made_by(spark, str(tmp_path / "few"))
    monkeypatch.setattr(chained, "HELD_NAMES", 20)
    taken, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: taken.append(len(rows := collect(self))) or rows)
    many = made_by(spark, str(tmp_path / "many"))
    again = made_by(spark, str(tmp_path / "again"))
    assert max(taken, default=0) < 20
    monkeypatch.undo()
    assert isinstance(few.files, list) and not isinstance(many.files, list)
    assert len(many.files) == len(few.files) == 60 and list(many.files) == few.files
    assert (many.files[0], many.files[-1], many.files[3:9:2]) == (few.files[0], few.files[-1], few.files[3:9:2])
    with pytest.raises(IndexError):
        many.files[60]
    assert merged_rows(spark, many) == merged_rows(spark, few)
    # The table's name follows from the lists, in whatever run.
    name = lambda made: made.combined.rsplit("/", 1)[-1]
    assert name(many) == name(again) and name(many).startswith("combined_60_") and name(many).endswith(".xlsx")
    places = [(r.map_file, r.status) for r in spark.read.parquet(many.sources).select("map_file", "status").collect()]
    assert len(places) == 60 and {s for _, s in places} == {"success"}
