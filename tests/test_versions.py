"""Versions of a table with several writers, rows that keep their numbers, and logs that are cleared up."""

import threading

import pytest
from pyspark.sql import functions as F

from prospectry.plans.reviewing import review_round, rows_to_review
from prospectry.sources import readers, writers
from prospectry.sources.store import Store
from prospectry.streaming.verdicts import current_evaluations, stream_latest_evaluation


def test_two_writers_lose_nothing(spark, tmp_path):
    """Both start from version 1; one makes version 2, the other is told and starts again from there."""
    root = str(tmp_path / "t")
    writers.write_version(spark.range(3), root)
    meet, tries = threading.Barrier(2), {10: 0, 20: 0}

    def work(number):
        def change(table):
            tries[number] += 1
            if tries[number] == 1:
                meet.wait(60)
            return table.union(spark.range(number, number + 1))

        writers.update_version(spark, root, change)

    both = [threading.Thread(target=work, args=(n,)) for n in tries]
    [t.start() for t in both]
    [t.join() for t in both]
    assert sorted(r.id for r in writers.read_version(spark, root).collect()) == [0, 1, 2, 10, 20]
    assert writers.versions(spark, root) == [1, 2, 3] and sorted(tries.values()) == [1, 2]
    assert len(Store(spark, root).names("data")) == 3  # the rows that came too late are gone


def test_a_stale_base_is_refused(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in (1, 2):
        writers.write_version(spark.range(n), root)
    with pytest.raises(writers.VersionTaken):
        writers.write_version(spark.range(9), root, after=1)
    writers.write_version(spark.range(3), root, after=2)
    assert [writers.read_version(spark, root, v).count() for v in (1, 2, 3)] == [1, 2, 3]
    # Rows without a manifest are no version.
    spark.range(99).write.parquet(f"{root}/data/unfinished")
    assert writers.versions(spark, root) == [1, 2, 3]


def test_old_versions_go(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in range(5):
        writers.write_version(spark.range(n), root)
    writers.expire_versions(spark, root, keep=2)
    assert writers.versions(spark, root) == [4, 5] and writers.read_version(spark, root).count() == 4
    assert len(Store(spark, root).names("data")) == 2
    writers.write_version(spark.range(7), root)
    assert writers.versions(spark, root) == [4, 5, 6]


def test_store_stays_below_its_root(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s p")
    assert store.create("a/b.json", "x") and not store.create("a/b.json", "y") and store.read("a/b.json") == "x"
    assert store.names("a") == ["b.json"] and store.names("none") == []
    for name in ("", "/etc", "a/../../b"):
        with pytest.raises(ValueError):
            store.remove(name)
    store.remove("a")
    store.remove("a")
    assert store.names("a") == []


_ORDER = ["seq"]


def _verdicts(spark, *rows):
    return spark.createDataFrame(rows, "file_idx int, row_idx long, eval_rating string, seq long").withColumns({"eval_time": F.lit("2026-01-01 10:00:00").cast("timestamp"), "notes": F.lit(" n ")})


def test_a_verdict_finds_its_row_in_the_next_version(spark, tmp_path):
    """Rows are known by their written numbers, whatever files and order a rewrite gives them."""
    tables, log = [str(tmp_path / "a"), str(tmp_path / "b")], str(tmp_path / "log")
    rows = spark.createDataFrame([("u", "A", "pending"), (None, "B", "pending"), (" ", "C", "pending"), ("u ", "D", "pending")], "listing_link string, name string, status string")
    for t in tables:
        writers.write_version(writers.with_row_ids(rows), t)
    seen = {(r.file_idx, r.name): r.row_idx for r in readers.scan_combined(spark, [writers.version_path(spark, t) for t in tables]).collect()}
    # Another job rewrites the table between the showing and the saving.
    writers.update_version(spark, tables[0], lambda t: t.orderBy(F.desc("name")).repartition(3))
    review_round(spark, tables, log, _verdicts(spark, (0, seen[0, "B"], "good", 1), (0, seen[0, "C"], "bad", 2), (1, seen[1, "A"], "okay", 3), (1, 12345, "lost", 4)), _ORDER)
    now = {(r.file_idx, r.name): (r.status, r.rating_tag, r.notes) for r in rows_to_review(spark, tables, writers.read_evaluations(spark, log), _ORDER).collect()}
    assert now == {
        (0, "A"): ("pending", "pending", ""), (0, "B"): ("good", "good", ""), (0, "C"): ("bad", "bad", ""), (0, "D"): ("pending", "pending", ""),
        (1, "A"): ("okay", "okay", "n"), (1, "B"): ("pending", "pending", ""), (1, "C"): ("pending", "pending", ""), (1, "D"): ("okay", "okay", "n"),
    }
    assert writers.read_evaluations(spark, log).count() == 3
    # The next round shows pending rows only, so a verdict on another row does not count.
    review_round(spark, tables, log, _verdicts(spark, (1, seen[1, "A"], "bad", 5), (1, seen[1, "B"], "good", 6)), _ORDER, "pending")
    now = {r.name: r.status for r in readers.scan_combined(spark, [writers.version_path(spark, tables[1])]).collect()}
    assert now == {"A": "okay", "B": "good", "C": "pending", "D": "okay"}
    assert [len(writers.versions(spark, t)) for t in tables] == [3, 3]


def test_a_followed_log_stays_small(spark, tmp_path):
    """Change folders behind the last two bases are removed by the stream itself, over many batches."""
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(24).selectExpr("concat('l', id % 5) AS listing_link", "id AS seq", "CAST(id AS string) AS eval_rating", "'n' AS notes")
    rows.repartition(24, "seq").write.option("maxRecordsPerFile", 1).parquet(source)
    stream_latest_evaluation(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source), ["seq"], root, compact_every=4).awaitTermination()
    store = Store(spark, root)
    assert len(store.names("changes")) <= 9 and len(writers.versions(spark, f"{root}/base")) == 2
    found = {r.link: r.eval_rating for r in current_evaluations(spark, root, ["seq"]).collect()}
    assert found == {f"l{i % 5}": str(i) for i in range(24)}
