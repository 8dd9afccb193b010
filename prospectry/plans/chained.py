"""The whole chain for a query list: collect, choose the result lists that exist, merge them, mark their rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from prospectry.constants import DEFAULT_MIN_RATING
from prospectry.functions.lists import digest_table_name
from prospectry.operators import searches
from prospectry.plans.collect import collect_listings
from prospectry.plans.merging import merge_lists
from prospectry.session import materialize
from prospectry.sources import readers, writers

#: Names of merged lists that the driver holds; more stay in their table.
HELD_NAMES = 10_000


class ListNames(Sequence):
    """Names of merged lists in their order, read from their table (``map_file, ord``) when asked for, a part at a time."""

    def __init__(self, lists: DataFrame, count: int) -> None:
        self.lists, self.count = lists.select("map_file", "ord"), count

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator[str]:
        return (r.map_file for r in self.lists.orderBy("ord").toLocalIterator())

    def __getitem__(self, at):
        if isinstance(at, slice):
            start, stop, step = at.indices(self.count)
            return list(islice(self, start, stop, step)) if step > 0 else list(self)[at]
        at = at + self.count if at < 0 else at
        if not 0 <= at < self.count:
            raise IndexError(at)
        return next(islice(self, at, None))

    def digest(self) -> int:
        """64 bits that follow from all names and their places, added up where the names lie."""
        total = self.lists.agg(F.sum(F.xxhash64("ord", "map_file").cast("decimal(38,0)"))).first()[0]
        return int(total) % (1 << 64)


class Chained(NamedTuple):
    status: int
    files: Sequence[str]
    combined: str | None
    sources: str | None
    summary: DataFrame | None


def available_lists(spark: SparkSession, root: str) -> DataFrame:
    """(slug, map_file) of the result lists that lie in an output folder: from the slugs of their common table, or of lists
    that have a folder each from the file listing alone.
    """
    if writers.versions(spark, root):
        slugs = writers.read_version(spark, root).select("slug")
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root)
        folder = F.regexp_extract("path", "/slug=([^/]*)/[^/]*$", 1)
        slugs = files.select(F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))).alias("slug"))  # a folder escapes some letters as %XX
    return slugs.where("slug <> ''").distinct().withColumn("map_file", F.concat("slug", F.lit(".xlsx")))


def read_lists(spark: SparkSession, root: str, lists: DataFrame, schema) -> DataFrame:
    """Rows of the chosen lists, one scan for all of them.

    ``lists`` has ``slug, map_file`` and ``ord``, the place of a list among the chosen ones; one that is chosen
    twice gives its rows twice. Folders of other slugs are pruned where the engine finds it worthwhile.
    """
    rows = writers.read_listings(spark, root, schema).select("*", readers.compact_place("parquet").alias("_place"))
    chosen = lists.select("slug", "map_file", F.col("ord").alias("_list"))
    joined = rows.join(chosen, "slug").withColumn("ord", F.struct(F.col("_list").alias("file_idx"), F.col("_place").alias("place")))
    return joined.drop("_list", "_place", "slug")


def run_pipeline(
    queries: DataFrame, pages: DataFrame, panels: DataFrame, root: str, redo: bool = False,
    min_rating: float = DEFAULT_MIN_RATING, flags: bool = True,
) -> Chained:
    """Collect the pending queries, then merge the lists that the finished ones should have made and that exist.

    Below ``root``: ``maps`` (the table of all lists, kept from earlier runs), ``queries`` (the list with its new
    statuses), ``combined`` (the merged table) and ``sources`` (the merged lists' rows with their statuses), the last two as
    versions of tables. Status 1 means that no list was there to merge. ``flags`` adds one column per list; leave it out
    where lists are many. The driver holds the names of up to ``HELD_NAMES`` lists; more stay in a table that ``files`` reads.
    """
    spark = queries.sparkSession
    maps = f"{root}/maps"
    found, outcomes = collect_listings(queries, pages, panels, redo)
    written = found.drop("page_id", "ord")
    writers.write_listings(written, maps, folders=False)
    writers.write_query_status(outcomes, f"{root}/queries")
    finished = writers.read_version(spark, f"{root}/queries")
    # Order and repeats of the finished queries stay; only the list names that exist are kept.
    expected = searches.expected_outputs(finished, "source_file").select("map_file", "ord")
    available = available_lists(spark, maps)
    existing = materialize(searches.existing_outputs(expected, available), "merged-lists")
    count, name = existing.count(), None
    if not count:
        return Chained(1, [], None, None, None)
    if count <= HELD_NAMES:
        files = [r.map_file for r in existing.orderBy("ord").collect()]
    else:
        files = ListNames(existing, count)
        name = digest_table_name(count, f"{files.digest():016x}", "xlsx")
    lists = existing.join(available, "map_file")
    rows = read_lists(spark, maps, lists, written.schema)
    merged = merge_lists(rows, files, min_rating, flags=flags)
    combined = writers.write_combined(merged.combined, f"{root}/combined", files, name)
    sources = writers.write_back_status(merged.sources, f"{root}/sources")
    return Chained(0, files, combined, sources, merged.summary)
