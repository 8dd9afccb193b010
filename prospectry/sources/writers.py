"""Writers. Nothing that is being read is overwritten: a changed table is a new version."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from prospectry.functions.lists import combined_table_name
from prospectry.operators.evaluations import union_evaluations
from prospectry.session import materialize
from prospectry.sources.store import Store


def write_listings(listings: DataFrame, root: str, processed: DataFrame | None = None, folders: bool = True) -> None:
    """One output per query slug; a slug written again replaces its old rows only.

    ``processed`` names all slugs of this run (column ``slug``). One that has no rows now gets a single
    row of nulls in place of its old rows; merges drop rows without a link.

    Rows are brought together by slug first, so a slug is few files and not one per task; adaptive
    execution splits a slug that is too large for one task. Every folder costs a few file operations, so where lists
    are many, ``folders=False`` keeps them in one table that holds ``slug`` as a column; :func:`read_listings` reads both.
    """
    if processed is not None:
        emptied = processed.select("slug").distinct().join(listings.select("slug").distinct(), "slug", "left_anti")
        listings = listings.unionByName(emptied, allowMissingColumns=True)
    if not folders:
        return _write_listings_together(listings, root)
    (
        listings.hint("rebalance", "slug").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("slug").parquet(root)
    )


#: Number of a row of a merged table.
ROW_ID = "row_id"
#: Bytes of text in one file of captured pages, about two seconds of parsing.
PAGE_FILE_BYTES = 4 << 20
#: Pages whose mean length stands for all; it only says how large files get.
PAGE_LENGTHS = 10_000


def write_pages(pages: DataFrame, path: str, text: str = "html", file_bytes: int = PAGE_FILE_BYTES) -> DataFrame:
    """Store captured pages in files of about ``file_bytes`` of text each, and read them back.

    A file is the least that a task takes, and pages compress well, so files bounded by their size on disk would give
    whole captures to one task. Parsing is the dear step; here its tasks follow from bytes of text.
    """
    mean = pages.select(F.octet_length(text).alias("n")).limit(PAGE_LENGTHS).agg(F.avg("n")).first()[0] or 1
    records = max(1, int(file_bytes / max(1, mean)))
    pages.write.option("maxRecordsPerFile", records).parquet(path)
    return pages.sparkSession.read.schema(pages.schema).parquet(path)


def with_row_ids(table: DataFrame) -> DataFrame:
    """Give each row a number that is written with it, so that it names the row in every later version."""
    return table if ROW_ID in table.columns else table.withColumn(ROW_ID, F.monotonically_increasing_id())


def write_combined(merged: DataFrame, folder: str, files: Sequence[str], name: str | None = None) -> str:
    """Overwrite the merged table of these inputs; its name follows from theirs unless given."""
    path = f"{folder}/{name or combined_table_name(list(files))}"
    with_row_ids(merged).write.mode("overwrite").parquet(path)
    return path


def append_evaluations(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_evaluations(spark: SparkSession, path: str) -> DataFrame:
    """The log with the union of all columns ever appended."""
    return spark.read.option("mergeSchema", True).parquet(path)


def compact_evaluations(log: DataFrame, rows: DataFrame, path: str) -> None:
    """Old log and new rows as one new table, columns united."""
    union_evaluations(log, rows).write.mode("errorifexists").parquet(path)


# A version is a folder of rows under ``data`` and a manifest that names it. The manifest's name is the version's number.
_MANIFESTS, _DATA = "versions", "data"


class VersionTaken(Exception):
    """Another writer has made the next version since this one looked."""


def versions(spark: SparkSession, root: str) -> list[int]:
    """Finished versions; a version counts once its manifest is there."""
    return sorted(int(n.removesuffix(".json")) for n in Store(spark, root).names(_MANIFESTS) if n.endswith(".json"))


def _manifest(version: int) -> str:
    return f"{_MANIFESTS}/{version:010d}.json"


def version_path(spark: SparkSession, root: str, version: int | None = None) -> str:
    """Folder of the rows of a version, the last one unless named."""
    version = version if version is not None else versions(spark, root)[-1]
    return f"{root}/{json.loads(Store(spark, root).read(_manifest(version)))['rows']}"


def write_version(table: DataFrame, root: str, after: int | None = None) -> str:
    """Next version of a table. Readers keep the old one until the new one is complete.

    Rows are written to a folder of their own first; the version is made by creating its manifest, which only one
    writer can. With ``after``, the version that the rows were derived from, a version made by another writer in the
    meantime raises :class:`VersionTaken`; without, the rows stand for themselves and take the next free number.
    """
    spark = table.sparkSession
    store, rows = Store(spark, root), f"{_DATA}/{uuid.uuid4().hex}"
    table.write.mode("errorifexists").parquet(f"{root}/{rows}")
    known = versions(spark, root)
    number = (known[-1] if known else 0) + 1 if after is None else after + 1
    while (known and number <= known[-1]) or not store.create(_manifest(number), json.dumps({"rows": rows, "after": number - 1})):
        if after is not None:
            store.remove(rows)
            raise VersionTaken(f"version {number} of {root}")
        number += 1
    return f"{root}/{rows}"


def update_version(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame], attempts: int = 10) -> str:
    """Make the next version by ``change`` of the last one; if another writer was faster, start again from that one's."""
    for _ in range(attempts):
        last = versions(spark, root)[-1]
        try:
            return write_version(change(read_version(spark, root, last)), root, after=last)
        except VersionTaken:
            continue
    raise VersionTaken(f"{root}: {attempts} attempts")


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(version_path(spark, root, version))


def expire_versions(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Remove all but the last ``keep`` versions: the manifest first, so that no reader finds one without rows."""
    store = Store(spark, root)
    for version in versions(spark, root)[: -max(1, keep)]:
        rows = json.loads(store.read(_manifest(version)))["rows"]
        store.remove(_manifest(version))
        store.remove(rows)


def _by_slug(listings: DataFrame) -> DataFrame:
    """Rows of a slug side by side and in the order of their ranks, so that files can be skipped by slug."""
    return listings.hint("rebalance", "slug").sortWithinPartitions("slug", *[c for c in ("position",) if c in listings.columns])


def _write_listings_together(listings: DataFrame, root: str) -> None:
    """Next version of the table of all lists: slugs without new rows keep their old ones."""
    spark = listings.sparkSession
    if not versions(spark, root):
        old = read_listings(spark, root, listings.schema)
        if old is None:
            try:
                write_version(_by_slug(listings), root, after=0)
                return
            except VersionTaken:
                pass
    fresh = materialize(listings, "lists")
    slugs = fresh.select("slug").distinct()
    renew = lambda old: _by_slug(old.join(slugs, "slug", "left_anti").unionByName(fresh, allowMissingColumns=True))
    if not versions(spark, root):  # so far one folder for each slug
        try:
            write_version(renew(old), root, after=0)
            return
        except VersionTaken:
            pass
    update_version(spark, root, renew)


def read_listings(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame | None:
    """All lists below ``root`` with their ``slug``, however they were written; None if there are none."""
    if versions(spark, root):
        return spark.read.schema(schema).parquet(version_path(spark, root))
    if any(n.startswith("slug=") for n in Store(spark, root).names("")):
        return spark.read.schema(schema).parquet(root)
    return None


def write_query_status(outcomes: DataFrame, root: str) -> str:
    return write_version(outcomes.drop("outcome"), root)


def write_back_status(table: DataFrame, root: str) -> str:
    return write_version(table.withColumn("status", F.col("status").cast("string")), root)
