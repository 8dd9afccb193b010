"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectry.session import bound_batches  # noqa: F401  (the operators take it from here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(**kinds: str) -> tuple[pa.Schema, str]:
    """Arrow and Spark schemas of one list of columns: name=kind."""
    of = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
        "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    }
    return pa.schema([(k, of[v]) for k, v in kinds.items()]), ", ".join(f"`{k}` {v}" for k, v in kinds.items())


def texts_as_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each value of a string column; null counts as empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


_KEPT: dict[object, object] = {}


def kept(name: object, make: Callable[[], object]) -> object:
    """``make()``, which a worker keeps for its later tasks until a task calls ``forget``."""
    if name not in _KEPT:
        forget()
        _KEPT[name] = make()
        give_back()  # what only the making took
    return _KEPT[name]


def forget() -> None:
    """Give up what this worker has kept for tasks of another operator, and the memory with it.

    Workers live on from one job to the next, and memory that they hold adds up with that of the next job.
    """
    _KEPT.clear()
    give_back()


def give_back() -> None:
    """Hand freed memory over to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_ids(df: DataFrame, id_column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id is not in the only column of ``ids``; rows without an id stay."""
    return df.join(ids, df[id_column] == ids[ids.columns[0]], "left_anti")


def row_key(id_column: str, text_column: str):
    """Hash of a row's id and text, null without an id; it tells texts under one id apart."""
    return F.when(F.col(id_column).isNotNull(), F.xxhash64(F.col(id_column).cast("long"), F.col(text_column).cast("string")))


def fold(id_column: str, parts: int):
    """crc32 of the id as text, modulo ``parts``; rows without an id belong to part 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % parts, F.lit(0))


def spread_join(rows: DataFrame, values: DataFrame, key: str, spread_by: str, salts: int = 32, how: str = "inner") -> DataFrame:
    """Join rows with a table that has one row per key, so that no key's rows meet in one task.

    Rows get a salt from ``spread_by``. The (key, salt) pairs that occur are found by an aggregation whose
    partial step shrinks a hot key to ``salts`` rows, get their values, and meet the rows by (key, salt).
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    pairs = salted.groupBy(key, "_salt").agg(F.lit(1).alias("_one")).drop("_one").join(values, key)
    return salted.join(pairs, [key, "_salt"], how).drop("_salt")
