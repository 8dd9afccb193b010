"""Session defaults and the shared work folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Safe on any cluster size: adaptive execution picks post-shuffle partition counts, splits
# skewed join partitions, and turns joins into broadcasts only on measured sizes.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    # The JVM leaves longer methods uncompiled; beyond this Spark generates many short ones instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Call sites are not recorded for every expression, which makes long plans quick to build.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Whole HTML pages travel to Python workers; small batches keep their memory bounded.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}


def build_session(app: str = "prospectry", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of one Arrow batch sent to a Python worker.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes as well as by rows, unless the session already uses smaller ones."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    text = str(spark.conf.get(key)).lower().removesuffix("b")
    if not text.isdigit() or not 0 < int(text) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def bound_methods(spark: SparkSession) -> None:
    """Have Spark cut generated methods that the JVM would not compile, unless the session already cuts shorter ones."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key)) > int(DEFAULTS[key]):
        spark.conf.set(key, DEFAULTS[key])


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside give up their shuffle files when they end, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: the one in ``spark.checkpoint.dir``.

    Where that is unset, a folder of the warehouse, which a cluster shares as well, takes its place.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read, and read it back.

    The copy lies in the shared folder, so losing an executor costs nothing that was done.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
