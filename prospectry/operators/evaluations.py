"""Reviewer verdicts: latest one per business, and their way back into the merged table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from prospectry.functions.text import no_match, normalize_status, strip


def filter_by_status(rows: DataFrame, wanted: str | None) -> DataFrame:
    if not (wanted or "").strip() or "status" not in rows.columns:
        return rows
    return rows.where(normalize_status(F.col("status")) == wanted.strip().lower())


def _link_key() -> Column:
    return F.nullif(strip(F.coalesce(F.col("listing_link"), F.lit(""))), F.lit(""))


def latest_evaluation(log: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Last appended row per trimmed link (and results table, named by ``by``).

    An aggregate instead of a ranking window: each task keeps one row per link, so a link with
    very many verdicts is never sorted in one place.
    """
    rest = [c for c in log.columns if c not in (*order, *by, "listing_link")]
    picked = F.max(F.struct(*order, *rest)).alias("_last")
    return (
        log.withColumn("link", _link_key()).where(F.col("link").isNotNull())
        .groupBy(*by, "link").agg(picked)
        .select(*by, "link", "_last.*")
    )


def union_evaluations(log: DataFrame, rows: DataFrame) -> DataFrame:
    return log.unionByName(rows, allowMissingColumns=True)


def attach_latest_evaluation(merged: DataFrame, latest: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shown rating and notes of every merged row; the rating falls back to the row's status."""
    previous = latest.select(
        *by, F.col("link").alias("_link"),
        F.col("eval_rating").alias("_rating"), F.col("notes").alias("_notes"),
    )
    saved = F.nullif(normalize_status(F.col("_rating")), F.lit(""))
    return (
        merged.withColumn("_link", F.coalesce(_link_key(), no_match(merged)))
        .join(previous, [*by, "_link"], "left")
        .withColumn("rating_tag", F.coalesce(saved, normalize_status(F.col("status"))))
        .withColumn("notes", F.coalesce("_notes", F.lit("")))
        .drop("_link", "_rating", "_notes")
    )


def evaluation_rows(merged: DataFrame, rating: Column, eval_time: Column, notes: Column) -> DataFrame:
    """Rows to append to the log: the whole merged row plus the verdict."""
    return merged.withColumns(
        {
            "eval_rating": rating,
            "eval_time": F.date_trunc("second", eval_time),
            "notes": strip(F.coalesce(notes, F.lit(""))),
        }
    )


def apply_evaluations(parent: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Write verdicts into the merged table's status.

    ``parent`` has ``file_idx, row_idx, listing_link, status``; ``verdicts`` has ``file_idx,
    row_idx, listing_link, rating`` and ``seq``, their order of saving. A verdict reaches all
    rows of its file with its trimmed link; one without a link, or whose link is absent,
    reaches the row it was given on. The last verdict that reaches a row wins.
    """
    last = F.max(F.struct("seq", "rating"))
    keyed = verdicts.withColumn("_link", _link_key())
    rows = parent.withColumn("_link", _link_key())
    by_link = (
        keyed.where(F.col("_link").isNotNull()).groupBy("file_idx", "_link").agg(last.alias("_a"))
    )
    absent = keyed.join(
        rows.where(F.col("_link").isNotNull()).select("file_idx", "_link"), ["file_idx", "_link"], "left_anti"
    )
    by_row = absent.groupBy("file_idx", "row_idx").agg(last.alias("_b"))
    return (
        rows.withColumn("_link", F.coalesce("_link", no_match(parent))).join(by_link, ["file_idx", "_link"], "left")
        .join(by_row, ["file_idx", "row_idx"], "left")
        .withColumn("status", F.coalesce(F.greatest("_a", "_b")["rating"], F.col("status")))
        .select(*parent.columns)
    )
