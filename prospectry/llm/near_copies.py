"""Near-copy removal: texts whose sets of word shingles have a Jaccard similarity of at least 4/5 are linked.

A fingerprint of 64 bits cannot stand for that bound: at 0.8 two SimHashes differ in about ten bits, give or take
three, so every limit that can be searched loses pairs. Candidates come from two places, and all are checked alike:

1. The Gray-order index of ``simhash`` finds the texts whose fingerprints, of the same shingles, differ in ``BITS`` bits
   or fewer. Each text is paired with the first one of its fingerprint, and these with each other as the index links them.
2. What lies further apart is found by the shingles themselves. They are put in one order for all texts, rare ones first. Two sets that are similar enough share a shingle
   among the first n - ceil(4n/5) + 1 of each, so only these are sent, as sorted blocks, to the shard of the shingle.
   A sample says which shingles are common; it decides the order alone, and any order gives the same links.
   A shard lists the texts that share such a shingle. Equal lists are kept once; long ones are cut into pairs of blocks.
3. Every list, those of the index included, is checked on whole sets, which lie memory-mapped in the shared folder. Texts that are connected
   already are not compared again, so m near copies cost about m comparisons and give m - 1 links.

Shingles are known by 64-bit hashes. The shared folder must be mounted on the executors.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectry.llm import simhash
from prospectry.llm.common import arrow_schema, bound_batches, free_name, spread_join, texts_as_bytes
from prospectry.llm.components import components
from prospectry.llm.ngram_lm import local_folder, pack, unpack
from prospectry.session import materialize, work_path

#: Words of a shingle, and the least similarity as a fraction.
WORDS, OVER, UNDER = 5, 4, 5
#: Bits in which fingerprints of candidates may differ.
BITS = 2
#: Texts that say which shingles are common, common shingles remembered, texts of a block, bytes of text for each shard.
SAMPLE, COMMON, BLOCK, SHARD_BYTES = 2000, 100_000, 512, 16 << 20
#: Shingles that a task gathers before it sends.
RUN_KEYS = 1 << 20


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of A-Z lower-cased text; a text of fewer words is one shingle."""
    tokens = text.lower().split()
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 5)], np.uint64)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 5) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())], np.uint64))


def fingerprint(own: np.ndarray) -> int:
    """SimHash of a set of shingles, as a signed 64-bit integer."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(own), 1 << 16):
        counts += np.unpackbits(own[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(own), bitorder="little").view("<i8")[0])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least OVER / UNDER."""
    both = len(a) + len(b)
    if (OVER + UNDER) * min(len(a), len(b)) < OVER * both:
        return False
    together = np.concatenate([a, b])
    together.sort(kind="stable")
    return (OVER + UNDER) * int((together[1:] == together[:-1]).sum()) >= OVER * both


def _common(docs: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several sampled texts hold, and in how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in texts_as_bytes(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], names=["key"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, rows // SAMPLE))) == 0)
    top = some.mapInArrow(run, "key long").groupBy("key").count().filter("count > 1").orderBy(F.desc("count"), "key").limit(COMMON).toArrow()
    keys = top["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top["count"].to_numpy()[order]


def first_shingles(own: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The shingles of a set, rare ones first, of which every similar set shares one among its own."""
    count = np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        count = np.where(common[at] == own, often[at], 0)
    need = -(-OVER * len(own) // UNDER)
    return own[np.argsort(count, kind="stable")[: len(own) - need + 1]]


def _write_sets(folder: str, shards: int, common: np.ndarray, often: np.ndarray):
    """Writes the sets of a partition to one file; sends nodes with their ids and fingerprints, and blocks of first shingles.

    A node is the number of the partition and the place in it.
    """
    schema, ddl = arrow_schema(shard="int", keys="binary", nodes="binary", id="long", node="long", key="long", fp="long")

    def block(keys: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        key, node = np.concatenate(keys), np.repeat(np.array(nodes, np.uint64), [len(k) for k in keys])
        shard = (key % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((key, shard))
        names, first = np.unique(shard[order], return_index=True)
        rows = [(int(s), pack(key[own]), pa.compress(node[own].tobytes(), codec="zstd", asbytes=True)) for s, own in zip(names, np.split(order, first[1:]))]
        columns = [*zip(*rows), *[[None] * len(rows)] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        place, ends, keys, nodes, held = f"{folder}/sets-{part}", [0], [], [], 0
        os.makedirs(folder, exist_ok=True)
        unfinished = f"{place}-{TaskContext.get().taskAttemptId()}"
        with open(unfinished, "wb") as file:
            for batch in batches:
                first, prints = len(ends) - 1, []
                for text in texts_as_bytes(batch.column(1)):
                    own = shingles(text)
                    prints.append(fingerprint(own))
                    file.write(own.tobytes())
                    nodes.append(part << 32 | len(ends) - 1)
                    keys.append(first_shingles(own, common, often))
                    ends.append(ends[-1] + len(own))
                    held += len(keys[-1])
                    if held >= RUN_KEYS:
                        yield block(keys, nodes)
                        keys, nodes, held = [], [], 0
                n = len(ends) - 1 - first
                empty = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), empty, empty, batch.column(0), pa.array(range(part << 32 | first, (part << 32 | first) + n), pa.int64()), batch.column(2), pa.array(prints, pa.int64())], schema=schema)
        if keys:
            yield block(keys, nodes)
        with open(f"{unfinished}-ends", "wb") as file:
            np.save(file, np.array(ends, np.int64))
        os.replace(f"{unfinished}-ends", f"{place}.ends")
        os.replace(unfinished, place)

    return run, ddl


@lru_cache(maxsize=4096)
def _opened(place: str) -> tuple[np.ndarray, np.ndarray]:
    ends = np.load(f"{place}.ends")
    return ends, np.memmap(place, np.uint64, "r")


def set_of(folder: str, node: int) -> np.ndarray:
    ends, values = _opened(f"{folder}/sets-{node >> 32}")
    at = node & 0xFFFFFFFF
    return np.asarray(values[ends[at] : ends[at + 1]])


def _lists(rows: pd.DataFrame) -> pd.DataFrame:
    """Lists of nodes that share a first shingle; ``cut`` nodes are compared with the others, or all with all if it is 0."""
    key = np.concatenate([unpack(x) for x in rows["keys"]])
    sizes = [int.from_bytes(x[:8], "little") for x in rows["keys"]]
    node = np.concatenate([np.frombuffer(pa.decompress(x, decompressed_size=8 * n, codec="zstd", asbytes=True), np.int64) for x, n in zip(rows["nodes"], sizes)])
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.append(begin[1:], len(key))
    many = end - begin > 1
    found = {node[a:b].tobytes() for a, b in zip(begin[many].tolist(), end[many].tolist())}
    out: list[tuple[list[int], int]] = []
    for own in (np.frombuffer(x, np.int64) for x in found):
        blocks = [own[at : at + BLOCK] for at in range(0, len(own), BLOCK)]
        out += [(b.tolist(), 0) for b in blocks if len(b) > 1]
        out += [([*a.tolist(), *b.tolist()], len(a)) for i, b in enumerate(blocks) for a in blocks[:i]]
    return pd.DataFrame({"nodes": [x[0] for x in out], "cut": [x[1] for x in out]})


def index_lists(nodes: DataFrame) -> DataFrame:
    """Pairs of texts (nodes, cut as in ``_lists``) from the SimHash index over columns node and fp.

    The index links fingerprints by a spanning forest, so m texts give about m pairs. They are candidates, to be checked.
    """
    first = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprint-classes")
    same = spread_join(nodes, first, "fp", "node").filter("node <> first").select(F.array("first", "node").alias("nodes"))
    linked = simhash.links(first.select("fp"), BITS).distinct().join(first.select(F.col("fp").alias("a"), F.col("first").alias("one")), "a")
    linked = spread_join(linked, first.select(F.col("fp").alias("b"), F.col("first").alias("other")), "b", "a")
    return same.unionByName(linked.select(F.array("one", "other").alias("nodes"))).withColumn("cut", F.lit(0))


def forest(sets: list[np.ndarray], cut: int) -> list[tuple[int, int]]:
    """Links that connect similar sets as all pairs do; with ``cut``, pairs have one set on each side of it."""
    n = len(sets)
    label, sizes, out = np.arange(n), np.array([len(s) for s in sets]), []
    for i in range(cut or n):
        for j in range(cut or i + 1, n):
            if label[i] != label[j] and (OVER + UNDER) * min(sizes[i], sizes[j]) >= OVER * (sizes[i] + sizes[j]) and similar(sets[i], sets[j]):
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _links(folder: str):
    schema, ddl = arrow_schema(a="long", b="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for nodes, cut in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, j in forest([set_of(folder, n) for n in nodes], cut):
                    a.append(nodes[i])
                    b.append(nodes[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run, ddl


def text_key(id_column: str, text_column: str):
    """Hash of a row's id and text; without an id, of the text. A null text counts as empty, as it does in its shingles."""
    return F.xxhash64(F.col(id_column).cast("long"), F.coalesce(F.col(text_column).cast("string"), F.lit("")))


def drop_near_copies(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, with one text of each group of linked texts: the one with the smallest id.

    A row goes by its id and its text, so another text under the same id is judged by its own links; of linked texts that
    share the smallest id one stays. Rows without an id stay beside those with one, but of such rows that are linked one text stays too.
    Repeated rows, id and text alike, stay or go together.
    Null and empty texts are linked with each other. Links count over any number of steps. An empty table gives no rows.
    """
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), text_key(id_column, text_column).alias("key"))
    size, rows = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    shards, folder = max(1, -(-(size or 0) // SHARD_BYTES)), local_folder(work_path(spark, "shingle-sets"))
    run, ddl = _write_sets(folder, shards, *_common(docs, rows))
    sent = materialize(docs.mapInArrow(run, ddl), "first-shingles")
    lists = sent.filter("shard IS NOT NULL").select("shard", "keys", "nodes").groupBy("shard").applyInPandas(_lists, "nodes array<long>, cut int")
    lists = lists.unionByName(index_lists(sent.filter("node IS NOT NULL").select("node", "fp")))
    run, ddl = _links(folder)
    lists = materialize(lists.distinct(), "shared-shingles")
    roots = components(lists.repartition(max(spark.sparkContext.defaultParallelism, min(4096, 4 * shards))).mapInArrow(run, ddl), "a", "b")
    nodes = sent.filter("node IS NOT NULL").select("id", "key", "node").join(roots, "node")
    nodes = materialize(nodes, "linked-texts")
    nodes = nodes.withColumn("named", F.col("id").isNotNull())
    first = nodes.groupBy("root", "named").agg(F.min(F.struct("id", "key")).alias("first"))
    gone = nodes.join(first, ["root", "named"]).filter("NOT struct(id, key) <=> first").select(F.col("id").alias("_gone"), F.col("key").alias("_gone_key")).distinct()
    key = free_name(df, "_key")
    marked = df.withColumn(key, text_key(id_column, text_column))
    gone = materialize(gone, "near-copies")
    return marked.join(gone, marked[id_column].cast("long").eqNullSafe(gone["_gone"]) & (marked[key] == gone["_gone_key"]), "left_anti").drop(key)
