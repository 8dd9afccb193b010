"""Line dedup by distinct-site spread, in DataFrame operations only.

A line that occurs on many sites is boilerplate and is removed wherever it occurs. Lines are known by a 128-bit
hash. Counting goes from cheap to exact:

1. A plain count finds the lines that occur often enough to reach the threshold at all.
2. Their sites go into HyperLogLog sketches, one for each (line, salt), merged for each line by aggregation.
3. Sketches far from the threshold decide; lines near it get an exact distinct count.

The band around the threshold is several hundred times wider than the sketches' standard error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectry.session import materialize

#: Sites from which a line counts as boilerplate, the sketches' size (2**LG_K registers), and salts of a line.
MIN_SITES, LG_K, SALTS = 5, 12, 16
#: Estimates within this factor of the threshold are counted exactly.
BAND = 2.0


def _hashes(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, salts: int = SALTS) -> DataFrame:
    """(a, b) of the lines that occur on ``min_sites`` sites or more, from rows (a, b, site)."""
    # The count has a partial step, so a very common line arrives as one row from each task.
    often = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites).select("a", "b")
    wanted = materialize(lines.join(often, ["a", "b"], "left_semi").groupBy("a", "b", "site").agg(F.count(F.lit(1)).alias("n")), "line-sites")
    part = F.pmod(F.xxhash64("site"), F.lit(salts))
    sketches = wanted.withColumn("salt", part).groupBy("a", "b", "salt").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    merged = sketches.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("sites"))
    judged = materialize(merged.filter(F.col("sites") >= min_sites / band), "line-spread")
    sure = judged.filter(F.col("sites") >= min_sites * band).select("a", "b")
    near = judged.filter(F.col("sites") < min_sites * band).select("a", "b")
    # One row is left for each (line, site), so counting rows is the exact distinct count.
    exact = wanted.filter("site IS NOT NULL").join(near, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("sites"))
    return sure.unionByName(exact.filter(F.col("sites") >= min_sites).select("a", "b"))


def remove_boilerplate(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", site_column: str = "source",
    min_sites: int = MIN_SITES, band: float = BAND, salts: int = SALTS,
) -> DataFrame:
    """doc_id, n_lines, n_removed, and the text that is left, for each row.

    Lines are parted by line feeds and compared as they are; lines without a visible character are never
    removed. A null site is no site. Null and empty texts have one empty line. Equal lines inside a document are
    removed together; repeated rows give equal rows; an empty table gives none; further columns are ignored.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), F.col(site_column).cast("string").alias("site"))
    key = F.xxhash64("doc_id", "text")
    solid = F.filter(F.array_distinct(_lines(F.col("text"))), lambda x: x.rlike(r"\S"))
    of_doc = docs.select(key.alias("key"), "doc_id", "site", F.transform(solid, _hashes).alias("hashes"))
    lines = of_doc.select("key", "doc_id", "site", F.inline("hashes"))
    spread = materialize(spread_lines(lines.select("a", "b", "site"), min_sites, band, salts), "boilerplate")
    hit = (
        lines.join(spread, ["a", "b"], "left_semi").groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct("a", "b")).alias("gone"))  # at most the lines of one document
    )
    kept = F.filter(_lines(F.col("text")), lambda x: ~F.array_contains(F.col("gone"), _hashes(x)))
    whole = docs.withColumn("key", key)
    joined = whole.join(hit.withColumnRenamed("doc_id", "_id"), (F.col("doc_id").eqNullSafe(F.col("_id"))) & (whole["key"] == hit["key"]), "left")
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n = F.size(_lines(F.col("text")))
    removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(n - F.size(kept))
    return joined.select("doc_id", n.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), left.alias("kept_text"))
