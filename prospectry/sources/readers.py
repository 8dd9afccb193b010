"""Readers. Tables are Parquet, CSV or JSON; each row can be given its place of origin."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote, urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from prospectry.constants import JSON_GUARD, QUERY_URL_HEADERS, SEARCH_VOLUME_HEADERS
from prospectry.operators.evaluations import filter_by_status
from prospectry.operators.merge import union_listings, with_listing_columns
from prospectry.sources import schemas

_MISSING_PATH = "PATH_NOT_FOUND"


def read_table(
    spark: SparkSession, path: str | list[str], fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", False)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_if_present(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame | None:
    try:
        return read_table(spark, path, fmt, schema)
    except AnalysisException as error:
        if error.getCondition() == _MISSING_PATH:
            return None
        raise


def file_row_order(fmt: str = "parquet") -> Column:
    """Place of a row inside its input, usable as order.

    Parquet numbers its rows. Text formats give the block a row was read from and its rank
    in the reading task, which grows along the block.
    """
    path = F.col("_metadata.file_path").alias("part")
    if fmt == "parquet":
        return F.struct(path, F.lit(0).cast("long").alias("block"), F.col("_metadata.row_index").alias("row_idx"))
    return F.struct(
        path, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row_idx")
    )


def normalize_query_headers(table: DataFrame) -> DataFrame:
    """Accept the known header spellings; add status and volume where they are missing."""
    found: dict[str, str] = {}
    for column in table.columns:
        key = column.strip().lower()
        for target, accepted in (
            ("query_url", QUERY_URL_HEADERS), ("status", ["status"]), ("search_volume", SEARCH_VOLUME_HEADERS)
        ):
            if key in accepted:
                found.setdefault(target, column)
    if "query_url" not in found:
        raise ValueError("a query list needs a query_url (or url, or link) column")
    out = table.withColumnsRenamed({old: new for new, old in found.items()})
    if "status" not in found:
        out = out.withColumn("status", F.lit(""))
    if "search_volume" not in found:
        out = out.withColumn("search_volume", F.lit(None).cast("double"))
    return out


def scan_queries(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return normalize_query_headers(read_table(spark, path, fmt))


def scan_listings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return with_listing_columns(read_table(spark, path, fmt))


def _list_name(path: str) -> str:
    last = path.rstrip("/").rsplit("/", 1)[-1]
    return f"{unquote(last.removeprefix('slug='))}.xlsx" if last.startswith("slug=") else last


def _place(uri: str) -> tuple[str, str]:
    """Store and decoded path of an address; a bare path has no store."""
    parts = urlsplit(uri)
    return (f"{parts.scheme}://{parts.netloc}", unquote(parts.path)) if parts.scheme else ("", uri)


def list_places(paths: Sequence[str], files: Sequence[str]) -> list[tuple[str, bool, int, str]]:
    """(address, whether it is a file, list number, list name) for the lists at ``paths``, given the addresses of their files.

    A list that is a file stands under its own address, one that is a folder under each folder that holds
    files of it. So the table is as long as the lists are many, not as long as their files.
    """
    lists: dict[tuple[str, str], list[int]] = {}
    for number, path in enumerate(paths):
        store, bare = _place(path.rstrip("/"))
        lists.setdefault((store, re.sub(r"^(\.\.?/)+", "", bare)), []).append(number)
    found = set()
    for uri in files:
        store, whole = _place(uri)
        names = whole.strip("/").split("/")
        for depth in range(len(names), 0, -1):
            # A path that starts at the root, or a relative one, which is known by its end.
            ways = [(store, "/" + "/".join(names[:depth])), ("", "/" + "/".join(names[:depth]))]
            ways += [("", "/".join(names[k:depth])) for k in range(depth)]
            for number in (n for way in ways for n in lists.get(way, ())):
                is_file = depth == len(names)
                found.add((uri if is_file else uri.rsplit("/", 1)[0], is_file, number, _list_name(paths[number])))
    return sorted(found)


# Addresses without a host are written with one slash or three.
_NO_ROOT = "^([a-z]+):/(?=[^/])"


def _with_root(uri: str) -> str:
    return re.sub(_NO_ROOT, r"\1:///", uri)


def compact_place(fmt: str) -> Column:
    """Place of a row in its list as numbers: part file, a hash of its name for parts that share a number, block, row."""
    name = F.col("_metadata.file_name")
    part = F.coalesce(F.regexp_extract(name, r"^part-(\d{1,9})", 1).try_cast("int"), F.lit(0))
    row = [F.lit(0).cast("long"), F.col("_metadata.row_index")] if fmt == "parquet" else [F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    return F.struct(part.alias("part"), F.xxhash64(name).alias("file"), row[0].alias("block"), row[1].alias("row_idx"))


# Columns of different types, and lists that are partitioned beside lists that are not.
_NOT_TOGETHER = ["CANNOT_MERGE_SCHEMAS", "CONFLICTING_DIRECTORY_STRUCTURES", "CONFLICTING_PARTITION_COLUMN_NAMES"]


def _read_together(spark: SparkSession, paths: Sequence[str], fmt: str) -> list[DataFrame]:
    """The lists as one table where their columns fit together, else one table each.

    CSV lists may differ in their headers, and one read takes a single header, so they are read one by one.
    """
    distinct = list(dict.fromkeys(paths))
    if fmt != "csv":
        try:
            reader = spark.read.format(fmt)
            return [(reader.option("mergeSchema", True) if fmt == "parquet" else reader).load(distinct)]
        except Exception as error:  # raised by a job that reads the footers, so not always an analysis error
            if not any(known in str(error) for known in _NOT_TOGETHER):
                raise
    return [read_table(spark, p, fmt) for p in distinct]


def scan_with_provenance(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Union of several result lists; every row knows its list and its place in the whole.

    A list is a file or a directory of part files, so its name is the last part of its path. One
    that this library collected (``slug=...``) goes by the name that its query expects. A path that is named
    twice gives its rows twice; paths are no patterns.

    All lists are one scan. A small table, one row for each folder of a list, says which list a row belongs to;
    what travels with a row is its list's name and ``ord``, which holds numbers only.
    """
    tables = []
    for table in _read_together(spark, paths, fmt):
        places = [(_with_root(address), is_file, number, name) for address, is_file, number, name in list_places(paths, table.inputFiles())]
        uri = F.regexp_replace("_metadata.file_path", _NO_ROOT, "$1:///")
        folder = F.regexp_extract(uri, "^(.*)/[^/]*$", 1)
        kinds = {p[1] for p in places}
        address = F.explode(F.array(folder, uri)) if len(kinds) == 2 else uri if kinds == {True} else folder
        placed = table.select("*", compact_place(fmt).alias("_place"), address.alias("_address"))
        numbers = spark.createDataFrame(places, "_address string, is_file boolean, file_idx int, map_file string")
        joined = placed.join(numbers, "_address")
        tables.append(with_listing_columns(joined.select(*table.columns, "map_file", F.struct("file_idx", F.col("_place").alias("place")).alias("ord"))))
    return union_listings(tables)


def scan_combined(
    spark: SparkSession, paths: Sequence[str], status: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Merged tables with a (file, row) id; missing ones are passed over.

    The row's id is the number that was written with it, which a rewrite keeps. Tables without one get a hash of the
    row's place, which holds for as long as the file does.
    """
    tables = []
    for index, path in enumerate(paths):
        table = read_if_present(spark, path, fmt)
        if table is not None:
            row = F.col("row_id") if "row_id" in table.columns else F.xxhash64(file_row_order(fmt))
            placed = table.select("*", F.lit(index).alias("file_idx"), row.alias("row_idx")).drop("row_id")
            tables.append(filter_by_status(placed, status))
    if not tables:
        raise ValueError("none of the merged tables exists")
    return union_listings(tables)


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def scan_captures(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Captured responses under one of the capture schemas."""
    return spark.read.schema(schema).parquet(path)


def scan_evaluations(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The ratings log; an empty one if nothing was rated yet."""
    log = read_if_present(spark, path, fmt)
    return spark.createDataFrame([], schemas.EVALUATIONS) if log is None else log


def parse_guarded_json(body: Column) -> Column:
    """JSON behind its guard, as a variant; null if it is not JSON."""
    return F.try_parse_json(F.regexp_replace(body, r"^([^)]*)\Q" + JSON_GUARD + r"\E", "$1"))


def place_field(body: Column, path: str, dtype: str) -> Column:
    return F.try_variant_get(parse_guarded_json(body), path, dtype)
