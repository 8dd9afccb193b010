"""SimHash near-dedup with a hierarchical index in Gray order.

Fingerprints are sorted by Gray rank, so that neighbours differ in few bits. A node of the index stands for a
run of them and holds the bits on which all of them agree (mask and pattern); bits that a parent already
holds are not looked at again. A search adds up differences on the way down and drops a node, with all that
is below it, once they exceed the limit.

The upper levels are spread over the cluster: a node there is a prefix of the Gray rank. A fingerprint visits
the prefixes that differ from its own in few enough bits, and only those that are not greater than its own,
which is where each pair is found once. A prefix that holds too many fingerprints is split by further bits
until it is small enough or all bits are used. Lower levels are built and searched inside one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectry.llm.common import arrow_schema, bound_batches, spread_join, texts_as_bytes, without_ids
from prospectry.llm.components import components
from prospectry.session import materialize

#: Fingerprints that a prefix should hold, and bits added when a prefix holds more than four times as many.
LEAF, MORE_BITS = 4096, 6
#: Children of a node of the index inside a task, and queries searched at a time.
FAN, AT_ONCE = 8, 2048


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of A-Z lower-cased text; 0 if it has no words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(words - 1, 0) if len(tokens) >= words else len(tokens) - 1
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(tokens) - last
    for at in range(0, n, 1 << 16):
        spans = zip(starts[at : min(n, at + (1 << 16))].tolist(), ends[at + last : at + last + (1 << 16)].tolist())
        h = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.dtype("<u8"))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of each row, a narrow step; fp is the fingerprint as a signed 64-bit integer."""
    schema, ddl = arrow_schema(doc_id="long", fp="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, words, seed) for t in texts_as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], schema=schema)

    bound_batches(df.sparkSession)
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, ddl)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of (mask, pattern) over fingerprints in Gray order, from few upper nodes to the fingerprints."""

    def __init__(self, codes: np.ndarray, fan: int = FAN) -> None:
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        ones, zeros = self.codes, ~self.codes
        levels = [(ones, zeros)]
        while len(ones) > fan:
            at = np.arange(0, len(ones), fan)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            levels.append((ones, zeros))
        self.levels, above = [], None
        for ones, zeros in reversed(levels):
            mask = ones | zeros
            held = mask if above is None else mask & ~np.repeat(above, fan)[: len(mask)]
            self.levels.append((held, ones))
            above = mask
        self.fan = fan

    def search(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of all pairs that differ in ``most`` bits or fewer."""
        q = np.repeat(np.arange(len(queries)), len(self.levels[0][0]))
        node = np.tile(np.arange(len(self.levels[0][0])), len(queries))
        so_far = np.zeros(len(q), np.uint8)
        for depth, (mask, pattern) in enumerate(self.levels):
            if depth:
                q, so_far = np.repeat(q, self.fan), np.repeat(so_far, self.fan)
                node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                real = node < len(mask)
                q, node, so_far = q[real], node[real], so_far[real]
            so_far = so_far + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
            keep = so_far <= most
            q, node, so_far = q[keep], node[keep], so_far[keep]
        return q, node


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Label of each of n nodes: the smallest node of its component under the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _search_prefix(most: int):
    """Searches one prefix: its own fingerprints (own = true) and its visitors; gives a spanning forest of the links."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        codes = rows["fp"].to_numpy().view(np.uint64)
        own = rows["own"].to_numpy()
        empty = pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})
        if not own.any():
            return empty
        index = GrayIndex(codes[own])
        nodes = np.concatenate([index.codes, codes[~own]])
        asking = nodes
        label = np.arange(len(nodes))
        for at in range(0, len(asking), AT_ONCE):
            q, place = index.search(asking[at : at + AT_ONCE], most)
            q = q + at
            differ = q != place  # the first nodes are the index itself
            if differ.any():
                label = _forest(np.concatenate([np.arange(len(nodes)), q[differ]]), np.concatenate([label, place[differ]]), len(nodes))
        linked = np.flatnonzero(label != np.arange(len(nodes)))
        if not len(linked):
            return empty
        return pd.DataFrame({"a": nodes[linked].view(np.int64), "b": nodes[label[linked]].view(np.int64)})

    return run


def _masks(bits: int, most: int) -> list[int]:
    """All patterns of ``bits`` bits with ``most`` ones or fewer; most is at most 2."""
    out = [0]
    if most >= 1:
        out += [1 << i for i in range(bits)]
    if most >= 2:
        out += [1 << i | 1 << j for i in range(bits) for j in range(i)]
    return out


def links(codes: DataFrame, most: int = 2, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints in column fp exactly as pairs within ``most`` bits do.

    Not all pairs are returned, but a spanning forest of those found in each prefix, so a dense group of m
    fingerprints gives fewer than m edges for each prefix that sees it. ``most`` is 0, 1 or 2.
    """
    if not 0 <= most <= 2:
        raise ValueError("links are found up to two bits")
    bits = max(0, (codes.count() // leaf).bit_length())
    top = F.shiftrightunsigned("fp", 64 - bits) if bits else F.lit(0).cast("long")
    entries = codes.select("fp", top.alias("prefix"))
    visits = entries.select("fp", F.col("prefix").alias("home"), F.lit(0).alias("spent"), F.lit(True).alias("new")).withColumn("prefix", F.col("home"))
    schema, added, found = "a long, b long", bits, []
    while True:
        # Visitors of a prefix: flips among the bits that were added last, within what is left of the limit.
        masks = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(bin(m).count("1")).alias("n")) for m in _masks(added, most)])
        visits = (
            visits.withColumn("flip", F.explode(masks))
            .select("fp", "home", (F.col("spent") + F.col("flip.n")).alias("spent"), F.col("prefix").bitwiseXOR(F.col("flip.m")).alias("prefix"))
            .filter((F.col("spent") <= most) & (F.col("prefix") <= F.col("home")))
        )
        # Beside a crowded prefix even a small one has many visitors; deeper bits turn most of them away.
        counts = entries.groupBy("prefix").agg(F.count(F.lit(1)).alias("own"))
        coming = visits.filter(F.col("prefix") != F.col("home")).groupBy("prefix").agg(F.count(F.lit(1)).alias("coming"))
        many = (F.col("own") > 4 * leaf) | (F.coalesce("coming", F.lit(0)) > 4 * leaf * len(_masks(bits, most)))
        heavy = materialize(counts.join(coming, "prefix", "left").filter(many).select("prefix"), "heavy-prefixes")
        last = bits >= 60 or heavy.isEmpty()
        small = lambda df: df if last else df.join(heavy, "prefix", "left_anti")
        own = small(entries).select("prefix", "fp", F.lit(True).alias("own"))
        others = small(visits).filter(F.col("prefix") != F.col("home")).select("prefix", "fp", F.lit(False).alias("own"))
        found.append(own.unionByName(others).groupBy("prefix").applyInPandas(_search_prefix(most), schema))
        if last:
            break
        added = min(MORE_BITS, 60 - bits)
        bits += added
        deeper = F.shiftrightunsigned("fp", 64 - bits)
        entries = materialize(entries.join(heavy, "prefix", "left_semi").select("fp", deeper.alias("prefix")), "gray-entries")
        low = F.lit((1 << added) - 1).cast("long")
        visits = materialize(
            visits.join(heavy, "prefix", "left_semi").select(
                "fp", deeper.alias("home"), "spent", F.shiftleft("prefix", added).bitwiseOR(deeper.bitwiseAND(low)).alias("prefix")
            ),
            "gray-visits",
        )
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def near_groups(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3, most: int = 2, leaf: int = LEAF,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links) of each row.

    Null and empty texts have fingerprint zero, which is linked like any other. Equal texts, repeated rows
    included, share a fingerprint and so a component. Rows without an id belong to their component; its id is
    null only if no row in it has one. An empty table gives no rows; further columns are ignored.
    """
    rows = materialize(fingerprints(df, id_column, text_column, words), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    roots = components(links(classes.select("fp"), most, leaf), "a", "b").select(F.col("node").alias("fp"), "root")
    classes = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = spread_join(classes.select("fp", "root"), first, "root", "fp").select("fp", "component_id")
    return spread_join(rows, named, "fp", "doc_id").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3, most: int = 2) -> DataFrame:
    """The rows of ``df``, all columns, whose id is the smallest of their component; rows without an id stay."""
    groups = near_groups(df, id_column, text_column, words, most)
    dropped = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return without_ids(df, id_column, materialize(dropped, "near-copies"))
