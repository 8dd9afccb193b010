"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectry.session import materialize


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) of every node of an edge between two different nodes; root is the component's smallest node.

    Each step replaces a node's edges by edges to its smallest neighbour, found by an aggregation with a
    partial step. Every round is a written table, so a lost executor costs one round at most. Rounds grow
    with the logarithm of the longest path. Nulls are left out; no edges give no rows.
    """
    a, b = F.col(left), F.col(right)
    now = materialize(
        edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "components"
    )
    before = None
    while True:
        # The rows are distinct, so their number and 128 bits of combined hashes say whether a round changed them.
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit("again"), "v", "u"))).first()
        if seen[0] == 0 or seen == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
