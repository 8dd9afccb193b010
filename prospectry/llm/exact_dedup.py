"""Exact dedup by skew-safe combining.

Equal means: identical after lower-casing A-Z. Copies are merged three times, each time comparing whole
contents, since the normalised text itself is part of the grouping key:

1. locally, in the partial step of the first aggregation, before anything is shuffled;
2. within (digest, salt), so that a text that fills a third of the table is spread over ``salts`` groups;
3. over the winners of the salts, which are at most ``salts`` rows for each text.

Every row then finds its winner by (digest, salt), a key that is as spread out as in step 2. Should two
texts share a digest, the rows of that digest are matched on content too.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectry.llm.common import arrow_schema, bound_batches, free_name, without_ids
from prospectry.session import materialize

SALTS = 32


def normalised(df: DataFrame, id_column: str, text_column: str, with_text: bool, digest_chars: int = 64) -> DataFrame:
    """(id, digest[, norm]) of each row: A-Z lower-cased, null as empty; the digest is SHA-256 in hex."""
    schema, ddl = arrow_schema(id="long", digest="string", **({"norm": "string"} if with_text else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = pc.ascii_lower(pc.fill_null(batch.column(1), ""))
            digest = pa.array([hashlib.sha256(x.as_buffer() or b"").hexdigest()[:digest_chars] for x in norm.cast(pa.binary())], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), digest, *([norm] if with_text else [])], schema=schema)

    bound_batches(df.sparkSession)
    return df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, ddl)


def exact_groups(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = SALTS, digest_chars: int = 64,
) -> DataFrame:
    """One row per input row: id column, keep_id, group_size, kept, text_sha256.

    Of equal texts, the row with the largest id stays. Rows without an id count in ``group_size`` but
    stay only if no row of the group has an id (keep_id is then null). Repeated rows, the id included, are
    all marked alike; ``drop_copies`` keeps one of them. Null and empty texts are one group; an empty table
    gives no rows; further columns are ignored. ``digest_chars`` shortens the digest that groups are found
    by (for tests of collisions); results do not depend on it.
    """
    if not 1 <= salts <= 63:
        raise ValueError("salts must lie between 1 and 63")
    salt = F.pmod(F.xxhash64("id"), F.lit(salts))
    rows = normalised(df, id_column, text_column, True, digest_chars).withColumn("salt", salt)
    # The first aggregation's partial step is the local one; its final step merges the salted groups.
    salted = rows.groupBy("digest", "salt", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("digest", "norm").agg(
        F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"),
        F.bit_or(F.expr("shiftleft(1L, cast(salt as int))")).alias("in_salts"),
    )
    narrow = materialize(
        winners.select("digest", F.sha2("norm", 256).alias("full"), "keep_id", "group_size", "in_salts"), "exact-winners"
    )
    shared = narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")
    spread = narrow.withColumn("salt", F.explode(F.expr(f"filter(sequence(0L, {salts - 1}L), s -> (shiftright(in_salts, cast(s as int)) & 1) = 1)")))
    members = normalised(df, id_column, text_column, False, digest_chars).withColumn("salt", salt)
    columns = [F.col("id").alias(id_column), "keep_id", "group_size", F.expr("id <=> keep_id").alias("kept"), F.col("full").alias("text_sha256")]
    if shared.isEmpty():
        return members.join(spread, ["digest", "salt"]).select(*columns)
    apart = members.join(spread.join(shared, "digest", "left_anti"), ["digest", "salt"]).select(*columns)
    # Digests of more than one text: match the rows on content.
    mixed = winners.join(shared, "digest", "left_semi").select("digest", "norm", "keep_id", "group_size")
    compared = rows.join(shared, "digest", "left_semi").join(mixed, ["digest", "norm"]).withColumn("full", F.sha2("norm", 256))
    return apart.unionByName(compared.select(*columns))


def drop_copies(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that ``exact_groups`` keeps; of repeated rows and of rows without an id one stays."""
    groups = materialize(exact_groups(df, id_column, text_column).select(F.col(id_column).alias("_id"), "kept", "text_sha256"), "exact-groups")
    rows, ids = groups.agg(F.count(F.lit(1)), F.count_distinct("_id")).first()
    if rows == ids:  # ids are a key: the dropped ids are enough
        return without_ids(df, id_column, groups.filter("NOT kept").select("_id"))
    norm = F.translate(F.coalesce(F.col(text_column).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    digest = free_name(df, "_digest")
    marked = df.withColumn(digest, F.sha2(norm, 256))
    kept = groups.filter("kept").distinct()
    match = marked[id_column].eqNullSafe(kept["_id"]) & (marked[digest] == kept["text_sha256"])
    return marked.join(kept, match, "left_semi").dropDuplicates([id_column, digest]).drop(digest)
