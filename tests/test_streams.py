"""Streams give the batch answer, also when they are stopped and go on later."""

import pytest

from prospectry.catalog import standins as st
from prospectry.catalog.merging import FILES
from prospectry.functions.lists import parse_categories
from prospectry.operators import evaluations as ev, merge
from prospectry.streaming.incremental import ListingStore, current_listings, incremental_listings
from prospectry.streaming.verdicts import current_evaluations, stream_latest_evaluation


def _rows(df):
    return sorted(map(repr, df.collect()))


def _batch_merge(spark, sf):
    return merge.combined_projection(merge.merge_listings(merge.filter_min_rating(st.parsed_listings(spark, sf)), FILES), FILES)


@pytest.mark.parametrize("compact_every", [2, 100])
def test_listings_after_a_restart(spark, sf, tmp_path, compact_every):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    rows = st.listings(spark, sf)

    def run():
        arrivals = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        parsed = arrivals.withColumn("categories", parse_categories(arrivals.categories))
        incremental_listings(parsed, FILES, root, 4.2, compact_every, slice_rows=500).awaitTermination()

    for part in range(2):
        rows.where(f"l_orderkey % 2 = {part}").repartition(2).write.mode("append").parquet(source)
        run()
    run()  # nothing new arrived
    batch = _batch_merge(spark, sf)
    assert _rows(current_listings(st.parsed_listings(spark, sf), FILES, root).select(*batch.columns)) == _rows(batch)


def _parts(spark, sf, n):
    rows = merge.filter_min_rating(st.parsed_listings(spark, sf))
    return [merge.appearance_partials(rows.where(f"l_orderkey % {n} = {k}")) for k in range(n)]


def test_store_survives_failures(spark, sf, tmp_path, monkeypatch):
    """Batches that are run again, and a compaction that breaks off at any of its writes, leave the batch answer."""
    parts = _parts(spark, sf, 5)
    make = lambda: ListingStore(spark, str(tmp_path / "s"), FILES, parts[0].schema, compact_every=2, slice_rows=300)
    for k, part in enumerate(parts):
        store = make()
        if k == 3:  # base and merged rows of the second compaction are written, its mark is not
            with monkeypatch.context() as m:
                m.setattr(spark, "createDataFrame", lambda rows, schema, real=spark.createDataFrame: real(rows, schema) if not rows else 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    store.absorb(part, k)
            assert make().base().upto == 1
            # What readers see meanwhile is whole.
            done = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
            expected = merge.combined_projection(merge.finish_merge(merge.combine_partials(done), FILES), FILES)
            assert _rows(make().current().select(*expected.columns)) == _rows(expected)
        store.absorb(part, k)
        store.absorb(part, k)
    batch = _batch_merge(spark, sf)
    assert _rows(make().current().select(*batch.columns)) == _rows(batch)
    assert make().base().upto == 3


def test_store_reads_only_what_holds_the_links(spark, sf, tmp_path):
    parts = _parts(spark, sf, 3)
    store = ListingStore(spark, str(tmp_path / "s"), FILES, parts[0].schema, compact_every=2, slice_rows=50)
    for k in (0, 1):
        store.absorb(parts[k], k)
    base = store.base()
    assert base.slices > 10
    one = store.add_run(parts[2].limit(1), 2).select("listing_link", "hash")
    plan = store.stored(one, 2)._jdf.queryExecution().executedPlan().toString()
    where = [p for p in plan.split("FileScan")[1:] if "slice#" in p]
    assert len(where) == 1 and "PartitionFilters: [isnotnull(slice" in where[0] and plan.count("LeftSemi") == 2
    read = store.base_rows(base, [r.s for r in one.selectExpr(f"CAST(pmod(hash, {base.slices}) AS INT) AS s").collect()]).select("_metadata.file_path").distinct().count()
    assert 0 < read <= store.base_rows(base).select("_metadata.file_path").distinct().count() // 10
    assert spark.read.parquet(f"{tmp_path}/s/changes/place=1").count() < store.current().count()


def test_store_keeps_its_folders(spark, sf, tmp_path):
    """Ten batches leave as many folders as two compactions need."""
    part = _parts(spark, sf, 40)[0]
    store = ListingStore(spark, str(tmp_path / "s"), FILES, part.schema, compact_every=2)
    for k in range(10):
        store.absorb(part, k)
    folders = [p for kind in ("runs", "changes", "base", "merged", "upto") for p in (tmp_path / "s" / kind).iterdir()]
    assert len(folders) == 2 * 4 + 3 * 2


def test_verdicts_after_a_restart(spark, sf, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    rows = st.verdicts(spark, sf).select("listing_link", "seq", "eval_rating", "eval_time", "notes")
    for part in range(2):
        rows.where(f"seq % 2 = {part}").coalesce(1).write.mode("append").parquet(source)
        stream_latest_evaluation(spark.readStream.schema(rows.schema).parquet(source), ["seq"], root).awaitTermination()
    batch = ev.latest_evaluation(rows, ["seq"])
    assert _rows(current_evaluations(spark, root, ["seq"]).select(*batch.columns)) == _rows(batch)


def test_a_load_is_as_many_files_as_it_takes(spark, tmp_path):
    from prospectry.catalog.jobs import _arrive_in_four

    source, seen = str(tmp_path / "source"), []

    def run(arrivals):
        note = lambda batch, _: seen.append(batch.count())
        return arrivals.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()

    _arrive_in_four(spark.range(0, 4000, 1, 5), "id", source, run)
    assert len(seen) == 4 and sum(seen) == 4000
    assert len(list((tmp_path / "source").glob("*.parquet"))) == 20
