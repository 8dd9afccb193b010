"""Merged businesses kept up to date as result lists arrive: a log-structured store.

Every batch adds a *run*: its appearances, sorted by the hash of their link. It then reads what the store holds of the
links it touched, and writes their merged rows as a run of *changes*; rows of other links are not written again. Every
``compact_every`` batches the runs are folded into a base, cut into slices by hash. A later batch reads only the slices that
hold its links, and of the runs only those since the last compaction.

Folders are reused, so their number is bounded: runs take turns in ``2 * compact_every`` places, the base in two. A base counts
once its small ``upto`` table is written, which names the last batch it holds, so a compaction that breaks off leaves the
old base in force. Every write replaces a whole place and every value is a minimum, so a batch that is run
again after a failure leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from prospectry.operators import merge
from prospectry.session import materialize
from prospectry.sources.readers import read_if_present

#: Batches between compactions, and appearances in a slice of the base.
COMPACT_EVERY, SLICE_ROWS = 16, 2_000_000


class Base(NamedTuple):
    """The base in force: its place, the last batch it holds, its slices. Before the first compaction there is none."""

    place: int
    upto: int
    slices: int


def _hash() -> Column:
    return F.xxhash64("listing_link")


def _slice(slices: int) -> Column:
    return F.pmod(F.col("hash"), F.lit(slices)).cast("int")


class ListingStore:
    """The tables of one store. ``appearances`` is the schema of :func:`merge.appearance_partials`."""

    def __init__(
        self, spark: SparkSession, root: str, files: Sequence[str], appearances: T.StructType, compact_every: int = COMPACT_EVERY, slice_rows: int = SLICE_ROWS
    ) -> None:
        self.spark, self.root, self.files = spark, root, files
        self.compact_every, self.slice_rows = compact_every, slice_rows
        self.appearances = T.StructType([*appearances.fields, T.StructField("hash", T.LongType()), T.StructField("batch", T.LongType())])
        self.plain = appearances
        merged = merge.combined_projection(merge.finish_merge(spark.createDataFrame([], appearances), files), files)
        self.merged = T.StructType([*merged.schema.fields, T.StructField("batch", T.LongType())])

    # --- places ---------------------------------------------------------------------------

    def _run(self, kind: str, batch: int) -> str:
        return f"{self.root}/{kind}/place={batch % (2 * self.compact_every)}"

    def base(self) -> Base | None:
        marks = [read_if_present(self.spark, f"{self.root}/upto/place={k}", schema=T._parse_datatype_string("upto long, slices int")) for k in (0, 1)]
        known = [Base(k, *row) for k, mark in enumerate(marks) if mark is not None for row in mark.collect()]  # one row each
        return max(known, key=lambda b: b.upto, default=None)

    def runs(self, kind: str, schema: T.StructType, after: int, upto: int | None = None) -> DataFrame:
        """Rows of the runs of the batches after ``after``; older rows wait in their places until those are used again."""
        found = read_if_present(self.spark, f"{self.root}/{kind}", schema=schema)
        if found is None:
            return self.spark.createDataFrame([], schema)
        rows = found.drop("place").where(F.col("batch") > after)
        return rows if upto is None else rows.where(F.col("batch") <= upto)

    def base_rows(self, base: Base, slices: Sequence[int] | None = None) -> DataFrame:
        """Appearances of the base, of all slices or the given ones."""
        rows = self.spark.read.schema(T.StructType([*self.appearances.fields, T.StructField("slice", T.IntegerType())])).parquet(f"{self.root}/base/place={base.place}")
        return (rows if slices is None else rows.where(F.col("slice").isin(list(slices)))).drop("slice")

    # --- steps of a batch ---------------------------------------------------------------------

    def add_run(self, partials: DataFrame, batch: int) -> DataFrame:
        """Store a batch's appearances, sorted, and give them back."""
        keyed = partials.select("*", _hash().alias("hash"), F.lit(batch).cast("long").alias("batch"))
        place = self._run("runs", batch)
        keyed.repartitionByRange("hash", *[F.col(c) for c in ("map_file", "position")]).sortWithinPartitions("hash", "listing_link").write.mode("overwrite").parquet(place)
        return self.spark.read.schema(self.appearances).parquet(place)

    def stored(self, touched: DataFrame, batch: int) -> DataFrame:
        """What the store holds of the links ``touched`` (listing_link, hash), this batch's run included."""
        base = self.base()
        links = touched.select("listing_link")
        rows = self.runs("runs", self.appearances, base.upto if base else -1, batch).join(links, "listing_link", "left_semi")
        if base:
            # Numbers of slices only, as many as the base has at most.
            slices = [r.slice for r in touched.select(_slice(base.slices).alias("slice")).distinct().collect()]
            rows = rows.unionByName(self.base_rows(base, slices).join(links, "listing_link", "left_semi"))
        return rows.select(*self.plain.names)

    def absorb(self, partials: DataFrame, batch: int) -> None:
        """One batch: its run, the merged rows of its links, and a compaction when it is due."""
        run = self.add_run(partials, batch)
        touched = materialize(run.select("listing_link", "hash").distinct(), "touched-links")
        merged = merge.combined_projection(merge.finish_merge(merge.combine_partials(self.stored(touched, batch)), self.files), self.files)
        merged.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(self._run("changes", batch))
        if (batch + 1) % self.compact_every == 0:
            self.compact(batch)

    def compact(self, batch: int) -> None:
        """Fold all runs up to ``batch`` into a new base in the other place."""
        base = self.base()
        after = base.upto if base else -1
        if after >= batch:
            return
        place = 1 - base.place if base else 0
        rows = self.runs("runs", self.appearances, after, batch)
        if base:
            rows = rows.unionByName(self.base_rows(base))
        slices = max(1, -(-rows.count() // self.slice_rows))
        whole = merge.combine_partials(rows.select(*self.plain.names)).select("*", _hash().alias("hash"), F.lit(batch).cast("long").alias("batch"))
        sliced = whole.withColumn("slice", _slice(slices)).hint("rebalance", "slice").sortWithinPartitions("slice", "hash", "listing_link")
        sliced.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("slice").parquet(f"{self.root}/base/place={place}")
        self.current(batch).withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.root}/merged/place={place}")
        self.spark.createDataFrame([(batch, slices)], "upto long, slices int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/upto/place={place}")

    def current(self, upto: int | None = None) -> DataFrame:
        """Merged rows of all links: the base's, replaced by the last change of each link since."""
        base = self.base()
        changes = self.runs("changes", self.merged, base.upto if base else -1, upto)
        last = changes.groupBy("listing_link").agg(F.max("batch").alias("batch"))
        newest = changes.join(last, ["listing_link", "batch"], "left_semi")
        if base:
            old = self.spark.read.schema(self.merged).parquet(f"{self.root}/merged/place={base.place}")
            newest = newest.unionByName(old.join(last, "listing_link", "left_anti"))
        return newest.drop("batch")


def incremental_listings(
    rows: DataFrame, files: Sequence[str], root: str, min_rating: float, compact_every: int = COMPACT_EVERY, slice_rows: int = SLICE_ROWS
) -> StreamingQuery:
    """Merge a stream of listing rows; done input is never read again.

    ``rows`` carries ``map_file`` and ``ord``. :func:`current_listings` reads the result.
    """

    def absorb(batch: DataFrame, batch_id: int) -> None:
        partials = merge.appearance_partials(merge.filter_min_rating(batch, min_rating))
        ListingStore(batch.sparkSession, root, files, partials.schema, compact_every, slice_rows).absorb(partials, batch_id)

    return (
        rows.writeStream.foreachBatch(absorb)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )


def current_listings(rows: DataFrame, files: Sequence[str], root: str) -> DataFrame:
    """The merged table of a store. ``rows`` is any table with the columns of the stream, for their types."""
    appearances = merge.appearance_partials(rows).schema
    return ListingStore(rows.sparkSession, root, files, appearances).current()
