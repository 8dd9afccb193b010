"""Rounds of review: show merged rows with their last verdicts, take new verdicts, write them back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from prospectry.operators import evaluations as ev
from prospectry.session import materialize
from prospectry.sources import readers, writers


def rows_to_review(spark: SparkSession, tables: Sequence[str], log: DataFrame, order: Sequence[str], status: str | None = None) -> DataFrame:
    """Rows of the merged tables (roots of versions) with a wanted status, each with the rating and notes it shows.

    ``log`` is the ratings log with the number of the table in ``file_idx``; the last of ``order`` wins.
    """
    rows = readers.scan_combined(spark, [writers.version_path(spark, t) for t in tables], status)
    latest = ev.latest_evaluation(log.select("listing_link", "file_idx", "eval_rating", "notes", *order), order, ["file_idx"])
    return ev.attach_latest_evaluation(rows.drop("notes"), latest, ["file_idx"])


def review_round(
    spark: SparkSession, tables: Sequence[str], log_path: str, verdicts: DataFrame, order: Sequence[str], status: str | None = None,
) -> DataFrame:
    """One round over merged tables. ``verdicts`` has ``file_idx, row_idx, eval_rating, eval_time, notes`` and ``order``.

    A verdict counts if its row is among the rows shown. It is appended to the log with the whole row, and becomes the
    status of all rows of its table with the row's link, or of the row itself if it has none; rows are known by the numbers
    written with them, so a verdict finds its row in whatever version is current by then. Each table gets one
    new version; a table without verdicts keeps its old one. Gives back the rows that were saved.
    """
    shown = rows_to_review(spark, tables, readers.scan_evaluations(spark, log_path).transform(_numbered(order)), order, status)
    rated = verdicts.select("file_idx", "row_idx", *order, F.col("eval_rating").alias("_rating"), F.col("eval_time").alias("_time"), F.col("notes").alias("_notes"))
    rated = shown.drop("rating_tag", "notes").join(rated, ["file_idx", "row_idx"])
    saved = ev.evaluation_rows(rated, F.col("_rating"), F.col("_time"), F.col("_notes")).drop("_rating", "_time", "_notes")
    saved = materialize(saved, "saved-verdicts")
    writers.append_evaluations(saved, log_path)
    seq = F.struct(*order).alias("seq")
    new = saved.select("file_idx", "row_idx", "listing_link", F.col("eval_rating").alias("rating"), seq)
    for index in sorted(r.file_idx for r in saved.select("file_idx").distinct().collect()):  # numbers of tables
        own = new.where(F.col("file_idx") == index)

        def applied(table: DataFrame, own: DataFrame = own, index: int = index) -> DataFrame:
            parent = table.withColumns({"file_idx": F.lit(index), "row_idx": F.col(writers.ROW_ID)})
            return ev.apply_evaluations(parent, own).select(*table.columns)

        writers.update_version(spark, tables[index], applied)
    return saved


def _numbered(order: Sequence[str]):
    """An empty log has the columns of any log, but not yet those that order it."""

    def add(log: DataFrame) -> DataFrame:
        missing = {c: F.lit(None).cast("long") for c in ("file_idx", *order) if c not in log.columns}
        return log.withColumns(missing) if missing else log

    return add
