"""The query list: what to process, what came out of it, which result lists to merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prospectry.functions.text import is_blank, normalize_status
from prospectry.functions.urls import query_slug


def should_process(status: Column, redo: bool) -> Column:
    """Decision and its reason for one query."""
    done = normalize_status(status) == "success"
    if redo:
        process, reason = F.lit(True), F.lit("rescrape")
    else:
        process = ~done
        reason = F.when(done, "already success").otherwise("pending/error/empty")
    return F.struct(process.alias("process"), reason.alias("reason"))


def select_pending(queries: DataFrame, redo: bool = False) -> DataFrame:
    decision = should_process(F.col("status"), redo)
    chosen = queries.where(~is_blank(F.col("query_url"))).withColumn("reason", decision["reason"])
    return chosen if redo else chosen.where(normalize_status(F.col("status")) != "success")


def blank_url_pending(queries: DataFrame) -> DataFrame:
    """A query without address waits; null counts as blank."""
    status = F.when(is_blank(F.col("query_url")), "pending").otherwise(F.col("status"))
    return queries.withColumn("status", status)


def attach_search_volume(listings: DataFrame, queries: DataFrame, on: list[str]) -> DataFrame:
    """Copy each query's volume to the listings found by it; ``queries`` is unique on ``on``."""
    volumes = queries.select(*on, "search_volume")
    return listings.drop("search_volume").join(volumes, on, "left")


def query_outcomes(queries: DataFrame, collected: DataFrame, redo: bool, on: list[str]) -> DataFrame:
    """Outcome and new status of every query, given the keys whose result page arrived."""
    arrived = collected.select(*on).distinct().withColumn("_arrived", F.lit(True))
    process = should_process(F.col("status"), redo)["process"]
    outcome = (
        F.when(is_blank(F.col("query_url")), "pending")
        .when(~process, "skipped")
        .when(F.col("_arrived"), "success")
        .otherwise("error")
    )
    return (
        queries.join(arrived, on, "left")
        .withColumn("outcome", outcome)
        .withColumn("status", F.when(F.col("outcome") == "skipped", F.col("status")).otherwise(F.col("outcome")))
        .drop("_arrived")
    )


def scrape_summary(outcomes: DataFrame, by: str) -> DataFrame:
    kinds = ["success", "error", "pending", "skipped"]
    return outcomes.groupBy(by).agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in kinds])


def expected_outputs(queries: DataFrame, by: str, extension: str = "xlsx") -> DataFrame:
    """Result-list names a query table should have produced, repeats kept.

    The rows marked success, or every row with an address where none is marked. The flag per
    table is aggregated and joined back: a window would put a whole table into one task.
    """
    success = normalize_status(F.col("status")) == "success"
    flags = queries.groupBy(by).agg(F.bool_or(success).alias("_any"))
    wanted = F.when(F.col("_any"), success).otherwise(~is_blank(F.col("query_url")))
    name = F.concat(query_slug(F.col("query_url")), F.lit(f".{extension}"))
    return queries.join(flags, by).where(wanted).drop("_any").withColumn("map_file", name)


def existing_outputs(expected: DataFrame, available: DataFrame) -> DataFrame:
    """Expected names that exist; order columns and repeats stay."""
    return expected.join(available.select("map_file"), "map_file", "left_semi")


def last_query_per_slug(queries: DataFrame) -> DataFrame:
    """Queries that share a slug write the same list, and the last one stays."""
    rest = [c for c in queries.columns if c not in ("slug", "ord")]
    last = queries.groupBy("slug").agg(F.max(F.struct("ord", *rest)).alias("q"))
    return last.select("slug", "q.*")
