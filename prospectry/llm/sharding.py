"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Rows lie in blocks, given by a hash of the row and its number among its copies, so that a task that runs again sees the
same blocks and copies spread. How many rows
a block sends to each shard is drawn from the multivariate hypergeometric distribution, block after block,
without replacement, which is how often a uniform shuffle would send them; the shards' sizes come out
exactly. Each block then permutes its rows and hands them out by these counts. Inside the shard they are permuted
again: rows draw a piece of the shard, the pieces' sizes are summed up, and each piece is permuted.

The matrix is drawn in two levels, so that nothing of the size of the table passes the driver: first for at most
``GROUPS`` groups of blocks on the driver, then for the blocks of each group in tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospectry.session import materialize

#: Rows that a block and a piece of a shard hold on average, and groups of blocks that the driver draws for.
BLOCK_ROWS, GROUPS = 1 << 15, 256


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows, taken without replacement from good + bad rows, are good.

    Inverts the distribution function over all values within 12 standard deviations; what lies beyond has a
    probability below the precision of a double.
    """
    low, high = max(0, draws - bad), min(good, draws)
    total = good + bad
    if low == high:
        return low
    mean = draws * good / total
    deviation = np.sqrt(mean * (bad / total) * (total - draws) / max(1, total - 1)) + 1
    low, high = max(low, int(mean - 12 * deviation)), min(high, int(mean + 12 * deviation) + 1)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], "right"))


def draw_matrix(rng: np.random.Generator, rows: list[int], capacities: np.ndarray) -> np.ndarray:
    """Counts (blocks x shards) with the given sums of rows and columns, drawn as a uniform shuffle has them."""
    left = capacities.astype(np.int64).copy()
    out = np.zeros((len(rows), len(left)), np.int64)
    for i, n in enumerate(rows):
        open_rows, rest = int(left.sum()), int(n)
        for j, size in enumerate(left.tolist()):
            open_rows -= size
            out[i, j] = hypergeometric(rng, size, open_rows, rest) if rest else 0
            rest -= int(out[i, j])
        left -= out[i]
    return out


def _matrix(counts: DataFrame, groups: int, capacities: np.ndarray, seed: int) -> DataFrame:
    """(block, upto): for each block the cumulative counts over the shards."""
    with_group = counts.withColumn("group", F.pmod("block", F.lit(groups)))
    of_group = {r["group"]: r["n"] for r in with_group.groupBy("group").agg(F.sum("n").alias("n")).collect()}
    names = sorted(of_group)
    shares = dict(zip(names, draw_matrix(np.random.default_rng(seed), [of_group[g] for g in names], capacities)))
    shared = counts.sparkSession.sparkContext.broadcast(shares)  # at most GROUPS x shards numbers

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        group = int(rows["group"].iloc[0])
        drawn = draw_matrix(np.random.default_rng([seed, group]), rows["n"].tolist(), shared.value[group])
        return pd.DataFrame({"block": rows["block"].to_numpy(), "upto": list(np.cumsum(drawn, axis=1))})

    return with_group.groupBy("group").applyInPandas(draw, "block long, upto array<long>")


def shuffle_into_shards(
    df: DataFrame, shards: int = 24, seed: int = 3, by: tuple[str, ...] = ("doc_id", "text"), block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``df``, all columns, with ``_shard`` (0 to shards - 1) and ``_slot`` (gapless from 0 inside each shard).

    Shard sizes differ by one at most. The result depends on ``seed`` and on the rows' content in the columns
    ``by``, nulls included, not on how the table is partitioned. Rows equal in ``by`` are interchangeable and
    each get a place of their own; content is known by 128 bits of hashes. An empty table gives no rows. Columns called _shard or _slot are replaced.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    df = df.drop("_shard", "_slot")
    # Whole rows travel as one struct, so that their column names cannot meet the ones used here. They are written once, with
    # a number that stays; all drawing and ordering is done on numbers and hashes, and each row moves once, to its place.
    whole = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"))
    key = [F.col("_row")[c] for c in by]
    whole = materialize(
        whole.select("_row", F.xxhash64(*key).alias("_a"), F.xxhash64(F.lit("shards"), *key).alias("_b"), F.monotonically_increasing_id().alias("_id")), "shard-rows"
    )
    narrow = whole.select("_a", "_b", "_id")
    n = narrow.count()
    blocks = max(1, -(-n // block_rows))
    pieces = max(1, -(-n // (shards * block_rows)))
    # The copies of a row are numbered: counted for each part of the table, summed up over the parts, ranked inside a part.
    narrow = narrow.withColumn("_part", F.shiftright("_id", 33))
    copies = narrow.groupBy("_a", "_b", "_part").agg(F.count(F.lit(1)).alias("_n"))
    parts_before = Window.partitionBy("_a", "_b").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    copies = copies.select("_a", "_b", "_part", F.coalesce(F.sum("_n").over(parts_before), F.lit(0)).alias("_first"))
    in_part = F.row_number().over(Window.partitionBy("_a", "_b", "_part").orderBy("_id"))
    rows = narrow.withColumn("_k", in_part).join(copies, ["_a", "_b", "_part"]).withColumn("_k", F.col("_k") + F.col("_first")).drop("_part", "_first")

    def mixed(purpose: int) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(purpose), "_a", "_b", "_k")

    rows = materialize(rows.withColumn("_block", F.pmod(mixed(0), F.lit(blocks))), "shard-keys")
    capacities = np.array([n // shards + (s < n % shards) for s in range(shards)], np.int64)
    counts = rows.groupBy(F.col("_block").alias("block")).agg(F.count(F.lit(1)).alias("n"))
    matrix = materialize(_matrix(counts, min(blocks, GROUPS), capacities, seed), "shard-matrix").withColumnRenamed("block", "_block")

    order = Window.partitionBy("_block").orderBy(mixed(1), "_a", "_b", "_k")
    ranked = rows.withColumn("_rank", F.row_number().over(order)).join(matrix, "_block")
    placed = materialize(
        ranked.withColumn("_shard", F.expr("size(filter(upto, c -> c < _rank))"))
        .withColumn("_piece", F.pmod(mixed(2), F.lit(pieces))).drop("upto", "_rank", "_block"), "shard-places"
    )
    sizes = placed.groupBy("_shard", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_shard", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_shard", "_piece").orderBy(mixed(3), "_a", "_b", "_k")
    slots = placed.withColumn("_at", F.row_number().over(inside)).join(starts, ["_shard", "_piece"]).select("_id", "_shard", (F.col("_start") + F.col("_at") - 1).alias("_slot"))
    return whole.select("_id", "_row").join(slots, "_id").select("_row.*", "_shard", "_slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; files hold ranges of slots, in order, so a shard may be larger than a task."""
    sharded.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.mode("overwrite").partitionBy("_shard").parquet(path)
