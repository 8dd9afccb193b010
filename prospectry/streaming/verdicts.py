"""Current verdict per business from the growing ratings log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from prospectry.functions.text import no_match, strip
from prospectry.operators.evaluations import latest_evaluation
from prospectry.sources.store import Store
from prospectry.sources.writers import expire_versions, read_version, versions, write_version


#: Batches between compactions of a followed log.
COMPACT_EVERY = 32


def stream_latest_evaluation(log: DataFrame, order: Sequence[str], root: str, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Follow the log. State is one row per link, and each batch stores the links it changed.

    A batch replaces its own partition, so running it again after a failure changes nothing. Every ``compact_every``
    batches the changes become a new base, and what the base before it held already is removed.
    """

    def publish(changed: DataFrame, batch_id: int) -> None:
        (
            changed.withColumn("batch", F.lit(batch_id))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch").parquet(f"{root}/changes")
        )
        if (batch_id + 1) % compact_every == 0:
            compact_evaluations(changed.sparkSession, root, order)
            forget_changes(changed.sparkSession, root)

    return (
        latest_evaluation(log, order).writeStream.outputMode("update").foreachBatch(publish)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )


def current_evaluations(spark: SparkSession, root: str, order: Sequence[str]) -> DataFrame:
    """Latest stored change of every link: the compacted base, if there is one, and the changes since."""
    log = spark.read.parquet(f"{root}/changes")
    if versions(spark, f"{root}/base"):
        base = read_version(spark, f"{root}/base")
        last = base.agg(F.max("batch")).first()[0]
        log = log.where(F.col("batch") > last).unionByName(base)
    return latest_evaluation(log.drop("batch").withColumnRenamed("link", "listing_link"), order)


def compact_evaluations(spark: SparkSession, root: str, order: Sequence[str]) -> str:
    """Write the current verdicts as a new base, so that reading costs follow the changes since, not all ever made."""
    last = spark.read.parquet(f"{root}/changes").agg(F.max("batch")).first()[0]
    return write_version(current_evaluations(spark, root, order).withColumn("batch", F.lit(last)), f"{root}/base")


def forget_changes(spark: SparkSession, root: str) -> None:
    """Remove the changes that the base before the last one holds, and bases older than that.

    One generation stays behind, for readers that have looked up the base and not yet read it.
    """
    known = versions(spark, f"{root}/base")
    if len(known) < 2:
        return
    held = read_version(spark, f"{root}/base", known[-2]).agg(F.max("batch")).first()[0]
    store = Store(spark, root)
    for name in store.names("changes"):
        if name.startswith("batch=") and held is not None and int(name.removeprefix("batch=")) <= held:
            store.remove(f"changes/{name}")
    expire_versions(spark, f"{root}/base")


def apply_current(merged: DataFrame, current: DataFrame) -> DataFrame:
    """The merged table with each business's latest verdict as its status; a business without one keeps its own."""
    verdicts = current.select(F.col("link").alias("_link"), F.col("eval_rating").alias("_rating"))
    link = F.nullif(strip(F.coalesce(F.col("listing_link"), F.lit(""))), F.lit(""))
    return (
        merged.withColumn("_link", F.coalesce(link, no_match(merged))).join(verdicts, "_link", "left")
        .withColumn("status", F.coalesce("_rating", "status")).select(*merged.columns)
    )
