"""Merging repeated listings into one row per business, and the bookkeeping around it.

Input rows carry ``map_file`` (the result list a row came from) and ``ord``, an orderable
value that is unique over the rows and grows in encounter order: list first, row second.
Every "first" below means smallest ``ord``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from prospectry.constants import COMBINED_COLUMNS, DEFAULT_MIN_RATING, LISTING_COLUMNS
from prospectry.functions.lists import parse_categories
from prospectry.functions.text import blank_to_null, is_blank, is_blank_or, no_match, strip, to_rating
from prospectry.sources import schemas

#: Appearances in one row of the long form.
CHUNK = 1000

FIRST_VALUE_COLUMNS = ["name", "website", "phone", "address", "reviews_count", "rating", "source_file"]


def valid_link(link: Column) -> Column:
    """A link that can serve as business key."""
    return ~is_blank(link)


def valid_link_text(link: Column) -> Column:
    """A link that counts in summaries and status matching."""
    return ~is_blank_or(link, "nan")


def with_listing_columns(rows: DataFrame) -> DataFrame:
    """Add each missing column of a results table as typed null."""
    missing = {
        name: F.lit(None).cast(schemas.LISTINGS[name].dataType)
        for name in LISTING_COLUMNS if name not in rows.columns
    }
    return rows.withColumns(missing) if missing else rows


def free_name(rows: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``rows`` has."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def normalize_listings(rows: DataFrame) -> DataFrame:
    """Numeric rating and array categories, once, at ingest."""
    types = dict(rows.dtypes)
    changes = {"rating": to_rating(F.col("rating"), types["rating"])}
    if types["categories"] == "string":
        changes["categories"] = parse_categories(F.col("categories"))
    return rows.withColumns(changes)


def union_listings(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def _rating_passes(rows: DataFrame, min_rating: float) -> Column:
    """The bare comparison stays visible on a double column, so the scan can use it."""
    dtype = dict(rows.dtypes)["rating"]
    if dtype == "double":
        return (F.col("rating") >= min_rating) & ~F.isnan("rating")
    return to_rating(F.col("rating"), dtype) >= min_rating


def filter_min_rating(rows: DataFrame, min_rating: float = DEFAULT_MIN_RATING) -> DataFrame:
    return rows.where(_rating_passes(rows, min_rating))


def source_index(files: Sequence[str]) -> dict[str, int]:
    """1-based index of every input; a repeated name keeps its last place."""
    return {name: i for i, name in enumerate(files, start=1)}


def flag_columns(files: Sequence[str], map_file: Column, combine) -> list[Column]:
    """One flag per input. The flag of a repeated name's earlier place is never set."""
    index = source_index(files)
    return [
        (combine(map_file == name) if index[name] == i else F.lit(False)).alias(f"query_filename{i}")
        for i, name in enumerate(files, start=1)
    ]


def _seen(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def source_flags(rows: DataFrame, files: Sequence[str]) -> DataFrame:
    """Per link, where it was seen; combines map-side, so a hot link is one row per task."""
    return (
        rows.where(valid_link(F.col("listing_link")))
        .groupBy("listing_link")
        .agg(*flag_columns(files, F.col("map_file"), _seen))
    )


def _present(name: str, dtype: str) -> Column:
    """The value, with NaN and blank text read as missing."""
    c = F.col(name)
    if dtype == "string":
        return blank_to_null(c)
    if dtype in ("double", "float"):
        return F.when(~F.isnan(c), c)
    return c


def _first(name: str, value: Column) -> Column:
    """Smallest (ord, value) over the rows that have a value."""
    return F.min(F.when(value.isNotNull(), F.struct("ord", value.alias("v")))).alias(name)


def _prepare(rows: DataFrame) -> DataFrame:
    """Keyed rows with an integer rank; fractions are cut, text must be a whole number."""
    keyed = rows.where(valid_link(F.col("listing_link")))
    return keyed.withColumns(
        {"position": F.col("position").try_cast("int"), "map_file": F.when(~is_blank(F.col("map_file")), F.col("map_file"))}
    )


def merge_appearances(rows: DataFrame) -> DataFrame:
    """Long form: one row per distinct (link, list, rank), with the volume at its first encounter.

    Nothing is gathered per link, so this form has no limit on appearances of one business.
    """
    return (
        _prepare(rows)
        .where(F.col("position").isNotNull())
        .groupBy("listing_link", "map_file", "position")
        .agg(F.min(F.struct("ord", "search_volume")).alias("first"))
        .select("listing_link", "map_file", "position", "first.ord", "first.search_volume")
    )


_APPEARANCE = ["listing_link", "map_file", "position"]


def appearance_partials(rows: DataFrame, extra_first: Iterable[str] = ()) -> DataFrame:
    """First step of the merge: one row per (link, list, rank) with its first known values.

    Rows without a usable rank form their own group and still feed fields and flags.
    """
    fields = [*FIRST_VALUE_COLUMNS, *extra_first]
    types = dict(rows.dtypes)
    categories = F.when(F.size("categories") > 0, F.col("categories"))
    return (
        _prepare(rows).groupBy(*_APPEARANCE)
        .agg(
            F.min(F.struct("ord", "search_volume")).alias("first"),
            _first("categories", categories),
            *[_first(n, _present(n, types[n])) for n in fields],
        )
    )


def combine_partials(partials: DataFrame) -> DataFrame:
    """Partials of separate loads as those of one load; every value is a minimum, so order is free."""
    values = [c for c in partials.columns if c not in _APPEARANCE]
    return partials.groupBy(*_APPEARANCE).agg(*[F.min(c).alias(c) for c in values])


def finish_merge(partials: DataFrame, files: Sequence[str], flags: bool = True) -> DataFrame:
    """Second step: gather the distinct appearances of each link.

    Without ``flags`` there is no column per input; ``map_files`` still tells where a link was seen.
    """
    fields = [c for c in partials.columns if c not in (*_APPEARANCE, "first", "categories")]
    volume = F.when(F.col("map_file").isNotNull(), F.col("first.search_volume"))
    entry = F.struct("first.ord", "position", "map_file", volume.alias("search_volume"))
    merged = partials.groupBy("listing_link").agg(
        F.array_sort(F.collect_list(F.when(F.col("position").isNotNull(), entry))).alias("seen"),
        *[F.min(n).alias(n) for n in ["categories", *fields]],
        *(flag_columns(files, F.col("map_file"), _seen) if flags else []),
    )
    no_categories = F.array().cast("array<string>")
    # A rank without a list counts only if no row before it has the same rank. There is at most one such entry for
    # each rank, and the search ends at the first equal rank.
    new_rank = lambda x, i: x["map_file"].isNotNull() | (F.array_position("seen.position", x["position"]) == i + 1)
    unlisted = F.exists("seen", lambda x: x["map_file"].isNull())
    merged = merged.withColumn("seen", F.when(unlisted, F.filter("seen", new_rank)).otherwise(F.col("seen")))
    return merged.select(
        "listing_link",
        F.col("seen.position").alias("position"),
        F.coalesce("categories.v", no_categories).alias("categories"),
        *[F.col(f"{n}.v").alias(n) for n in fields],
        F.col("seen.search_volume").alias("search_volume"),
        F.col("seen.map_file").alias("map_files"),
        F.lit("pending").alias("status"),
        *[f"query_filename{i}" for i in range(1, len(files) + 1 if flags else 1)],
    )


def merge_listings(rows: DataFrame, files: Sequence[str], extra_first: Iterable[str] = (), flags: bool = True) -> DataFrame:
    """One row per link: first known value of each field, every appearance, a flag per input.

    Two aggregations, both with map-side partial steps. The first is keyed on
    (link, list, rank), which spreads a link that fills a large share of the input over many
    tasks and shrinks it to its distinct appearances. The second gathers those per link: at
    most (inputs x ranks on one result page) entries, since inputs are the caller's ``files``
    and ranks come from one page. :func:`merge_listings_long` is the form without that bound.
    """
    return finish_merge(appearance_partials(rows, extra_first), files, flags)


def _list_number(partials: DataFrame) -> Column:
    """The leading field of ``ord``: the list a row came from."""
    ord_type = partials.schema["first"].dataType["ord"].dataType
    if ord_type.typeName() != "struct":
        raise ValueError("ord must be a struct that starts with the number of the list")
    return F.col("first.ord")[ord_type.names[0]]


def number_appearances(partials: DataFrame) -> DataFrame:
    """(listing_link, index, position, map_file, search_volume): the place of each appearance among those of its link.

    No task sorts all appearances of a link. They are counted for each (link, list), the counts are summed up along the
    lists, and only the ranks of one list are sorted together; ``ord`` grows list by list.
    """
    entry = partials.where(F.col("position").isNotNull()).select(
        "listing_link", "map_file", "position", F.col("first.ord").alias("ord"), "first.search_volume", _list_number(partials).alias("_list")
    )
    listed = entry.where(F.col("map_file").isNotNull())
    # A rank without a list counts only if no row before it has the same rank.
    first = listed.groupBy("listing_link", "position").agg(F.min("ord").alias("_first"))
    unlisted = (
        entry.where(F.col("map_file").isNull()).join(first, ["listing_link", "position"], "left")
        .where(F.col("_first").isNull() | (F.col("ord") < F.col("_first")))
        .withColumn("search_volume", F.lit(None).cast("double")).select(*entry.columns)
    )
    seen = listed.unionByName(unlisted)
    before = F.sum("_n").over(Window.partitionBy("listing_link").orderBy("_list").rowsBetween(Window.unboundedPreceding, -1))
    counts = seen.groupBy("listing_link", "_list").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    within = F.row_number().over(Window.partitionBy("listing_link", "_list").orderBy("ord"))
    return seen.withColumn("_within", within).join(counts.drop("_n"), ["listing_link", "_list"]).select(
        "listing_link", (F.col("_before") + F.col("_within") - 1).alias("index"), "position", "map_file", "search_volume"
    )


def merge_listings_long(rows: DataFrame, chunk: int = CHUNK, extra_first: Iterable[str] = ()) -> DataFrame:
    """The merge for links with any number of appearances: one row per (link, chunk) of at most ``chunk`` of them.

    Chunks are numbered from 0 in encounter order; together their arrays are those of :func:`merge_listings`. Every
    chunk carries the link's fields; a link without a usable rank has one chunk with empty arrays.
    """
    partials = appearance_partials(rows, extra_first)
    fields = [c for c in partials.columns if c not in (*_APPEARANCE, "first", "categories")]
    known = partials.groupBy("listing_link").agg(*[F.min(n).alias(n) for n in ["categories", *fields]])
    entry = F.struct("index", "position", "map_file", "search_volume")
    seen = number_appearances(partials).withColumn("chunk", F.floor(F.col("index") / chunk))
    chunks = seen.groupBy("listing_link", "chunk").agg(F.array_sort(F.collect_list(entry)).alias("seen"))
    nothing = F.array().cast(chunks.schema["seen"].dataType)
    whole = known.join(chunks, "listing_link", "left").withColumn("seen", F.coalesce("seen", nothing))
    return whole.select(
        "listing_link", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.col("seen.position").alias("position"),
        F.coalesce("categories.v", F.array().cast("array<string>")).alias("categories"), *[F.col(f"{n}.v").alias(n) for n in fields],
        F.col("seen.search_volume").alias("search_volume"), F.col("seen.map_file").alias("map_files"), F.lit("pending").alias("status"),
    )


def combined_projection(merged: DataFrame, files: Sequence[str], extra: Iterable[str] = (), flags: bool = True) -> DataFrame:
    """Fixed column order; a flag that is missing reads false."""
    shown = [
        F.coalesce(F.col(n), F.lit(False)).alias(n) if n in merged.columns else F.lit(False).alias(n)
        for n in (f"query_filename{i}" for i in range(1, len(files) + 1 if flags else 1))
    ]
    return merged.select(*COMBINED_COLUMNS, *shown, *extra)


def distinct_links(merged: DataFrame) -> DataFrame:
    """Trimmed links of a merged table."""
    link = F.col("listing_link")
    return merged.where(valid_link_text(link)).select(strip(link).alias("link")).distinct()


def mark_included(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Status of source rows: ``success`` where the trimmed link was merged, else ``pending``.

    ``links`` holds one row per link, so the join never multiplies rows, and a hot link on the
    row side is split by adaptive skew handling. Rows without a link get keys that match nothing and
    spread over all tasks.
    """
    key = F.when(valid_link_text(F.col("listing_link")), strip(F.col("listing_link"))).otherwise(no_match(rows))
    included = links.select(F.col("link").alias("_key"), F.lit(True).alias("_in"))
    return (
        rows.withColumn("_key", key)
        .join(included, "_key", "left")
        .withColumn("status", F.when(F.col("_in"), "success").otherwise("pending"))
        .drop("_key", "_in")
    )


def _by_link(rows: DataFrame, key: Column, links: DataFrame, how: str) -> DataFrame:
    """The key is a column of its own: sorting for a join would work out an expression again for each comparison."""
    name = free_name(rows, "_key")
    return rows.withColumn(name, key).join(links.select(F.col("link").alias(name)), name, how).drop(name)


def included_rows(rows: DataFrame, links: DataFrame) -> DataFrame:
    usable = rows.where(valid_link_text(F.col("listing_link")))
    return _by_link(usable, strip(F.col("listing_link")), links, "left_semi")


def excluded_rows(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows without a usable link are among them; they spread over all tasks."""
    key = F.when(valid_link_text(F.col("listing_link")), strip(F.col("listing_link"))).otherwise(no_match(rows))
    return _by_link(rows, key, links, "left_anti")


def dedup_summary(rows: DataFrame, min_rating: float = DEFAULT_MIN_RATING) -> DataFrame:
    """Counts of one merge: in, cut by rating, cut without link, cut as repeats, out.

    Repeats are counted on trimmed links, merged rows on raw ones. Counting per raw link
    first, then per trimmed link, keeps every step a plain partial aggregation; several
    ``count(distinct)`` side by side would copy the whole input once for each.
    """
    passes = F.coalesce(_rating_passes(rows, min_rating), F.lit(False))
    per_raw = rows.groupBy("listing_link").agg(
        F.count("*").alias("before"), F.count_if(passes).alias("kept")
    )
    usable = valid_link_text(F.col("listing_link"))
    keyed = valid_link(F.col("listing_link")) & (F.col("kept") > 0)
    per_link = per_raw.groupBy(F.when(usable, strip(F.col("listing_link"))).alias("link")).agg(
        F.sum("before").alias("before"), F.sum("kept").alias("kept"), F.count_if(keyed).alias("out")
    )
    has_link = F.col("link").isNotNull()
    total = per_link.agg(
        F.coalesce(F.sum("before"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"),
        F.coalesce(F.sum(F.when(has_link, F.col("kept"))), F.lit(0)).alias("usable"),
        F.count_if(has_link & (F.col("kept") > 0)).alias("links"),
        F.coalesce(F.sum("out"), F.lit(0)).alias("rows_out"),
    )
    return total.select(
        "rows_before",
        (F.col("rows_before") - F.col("kept")).alias("removed_by_rating"),
        (F.col("kept") - F.col("usable")).alias("removed_no_link"),
        (F.col("usable") - F.col("links")).alias("removed_by_dedup"),
        "rows_out",
    )
