"""Ranked lexical search: the k best documents of every item, found by a dual-tree search.

A document is a vector with one coordinate for each term of the items, an item a vector of term weights, and the
score is their product. Both kinds of vectors stand in trees whose nodes hold coordinate maxima, so the product of
two nodes bounds the score of every pair below them. A pair of nodes is left out, with all its documents and items,
if that bound is under the weakest k-th best score of the node's items. Scores are integers, so nothing is lost by
rounding, and a bound equal to a k-th score is followed, since a tie may hold a smaller doc_id.

1. Texts are read once: counts of the items' terms become a narrow table; totals and document frequencies come from it.
2. The best scores within a small sample of documents are lower bounds of the k-th scores, whatever the sample is.
3. Every task searches its documents, some thousands at a time, and returns the k best of each item.
4. The k best of (item, salt), then of the item: no task gets more than the k best of each task.

Items are the query set. They are taken in blocks of bounded size, each with its own pass over the documents.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prospectry.llm.common import arrow_schema, bound_batches, texts_as_bytes
from prospectry.session import materialize

#: Best documents of an item; rows and bytes of items in one pass; documents that are searched together or sampled for first bounds.
BEST, ITEMS, ITEM_BYTES, TOGETHER, SAMPLE = 10, 1024, 1 << 20, 2048, 4096
#: Documents of a leaf, items of a leaf, and children of an inner node.
DOC_LEAF, ITEM_LEAF, FAN = 16, 8, 8
SALTS = 64
#: ASCII letters and digits, and every byte of other characters.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
LAST_ID = (1 << 63) - 1


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text, A-Z lower-cased."""
    return TERM.findall(text.lower())


@dataclass
class Node:
    """Items ``first`` to ``last``: maxima of their weights for ``terms``, and at a leaf the weights themselves."""

    first: int
    last: int
    terms: np.ndarray
    most: np.ndarray
    weights: np.ndarray | None
    children: list[Node]


def item_tree(vectors: list[tuple[np.ndarray, np.ndarray]]) -> Node:
    """Tree over (terms, weights) of items, in the order given."""
    level = []
    for at in range(0, len(vectors), ITEM_LEAF):
        own = vectors[at : at + ITEM_LEAF]
        terms = np.unique(np.concatenate([t for t, _ in own]))
        weights = np.zeros((len(terms), len(own)), np.int64)
        for k, (t, w) in enumerate(own):
            weights[np.searchsorted(terms, t), k] = w
        level.append(Node(at, at + len(own), terms, weights.max(1, initial=0), weights, []))
    while len(level) > 1:
        above = []
        for at in range(0, len(level), FAN):
            own = level[at : at + FAN]
            terms = np.unique(np.concatenate([c.terms for c in own]))
            most = np.zeros(len(terms), np.int64)
            for c in own:
                place = np.searchsorted(terms, c.terms)
                most[place] = np.maximum(most[place], c.most)
            above.append(Node(own[0].first, own[-1].last, terms, most, None, own))
        level = above
    return level[0]


class Search:
    """The k best documents of each item so far, and the pruned search that improves them."""

    def __init__(self, tree: Node, most: np.ndarray, least: np.ndarray, k: int) -> None:
        self.tree, self.most, self.k = tree, most, k
        self.least = least.copy()  # a score under this cannot be among the k best of its item
        self.best: list[list[tuple[int, int]]] = [[] for _ in least]  # heaps of (score, -doc_id)
        self.local = np.full(len(most), -1, np.int64)
        self.visited = 0

    def add(self, ids: np.ndarray, owner: np.ndarray, terms: np.ndarray, values: np.ndarray) -> None:
        """Search documents ``ids``, whose coordinates are (document, term, value)."""
        if not len(terms):
            return
        present = np.unique(terms)
        self.local[present] = np.arange(len(present))
        # Documents with the same leading term stand together, so that the maxima of their node stay low.
        order = np.lexsort((-values * self.most[terms], owner))
        leading = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
        rank = np.argsort(self.most[terms[leading]] * (len(self.most) + 1) + terms[leading], kind="stable")
        ids = ids[owner[leading]][rank]
        place = np.full(owner.max() + 1, -1, np.int64)
        place[owner[leading][rank]] = np.arange(len(rank))
        leaves = -(-len(ids) // DOC_LEAF)
        rows = np.zeros((leaves * DOC_LEAF, len(present)), np.int32)  # a value is less than a million
        rows[place[owner], self.local[terms]] = values
        self.ids, self.rows = ids, rows
        self.levels = [rows.reshape(leaves, DOC_LEAF, -1).max(1)]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            cut = range(0, len(below), FAN)
            self.levels.append(np.stack([below[a : a + FAN].max(0) for a in cut]))
        self.places: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._pair(len(self.levels) - 1, 0, self.tree, self._bound(len(self.levels) - 1, 0, self.tree))
        self.local[present] = -1

    def _place(self, node: Node) -> tuple[np.ndarray, np.ndarray]:
        """Which of the node's terms these documents have, and in which column."""
        found = self.places.get(id(node))
        if found is None:
            column = self.local[node.terms]
            here = np.flatnonzero(column >= 0)
            found = self.places[id(node)] = here, column[here]
        return found

    def _bound(self, level: int, at: int, node: Node) -> int:
        here, column = self._place(node)
        return int(self.levels[level][at, column].astype(np.int64) @ node.most[here])

    def _pair(self, level: int, at: int, node: Node, bound: int) -> None:
        if bound < self.least[node.first : node.last].min():
            return
        self.visited += 1
        if level == 0 and node.weights is not None:
            self._score(at, node)
            return
        below = [(level, at)] if level == 0 else [(level - 1, c) for c in range(at * FAN, min(at * FAN + FAN, len(self.levels[level - 1])))]
        nodes = [node] if node.weights is not None else node.children
        pairs = [(self._bound(v, c, n), v, c, n) for v, c in below for n in nodes]
        for bound, v, c, n in sorted(pairs, key=lambda p: -p[0]):  # the best first, so that the k-th scores rise early
            self._pair(v, c, n, bound)

    def _score(self, leaf: int, node: Node) -> None:
        here, column = self._place(node)
        a = leaf * DOC_LEAF
        scores = self.rows[a : a + DOC_LEAF, column].astype(np.int64) @ node.weights[here]
        doc, item = np.nonzero(scores >= self.least[node.first : node.last])
        for d, i in zip(doc.tolist(), item.tolist()):
            if a + d >= len(self.ids):
                continue
            heap, entry = self.best[node.first + i], (int(scores[d, i]), -int(self.ids[a + d]))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[node.first + i] = max(self.least[node.first + i], heap[0][0])


def _count_terms(docs: DataFrame, index: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document that has a term: all its terms counted, those of the items listed."""
    schema, ddl = arrow_schema(doc_id="long", n="long", terms="array<int>", counts="array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, terms, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1))):
                found = terms_of(text)
                if found:
                    own = Counter(i for i in map(index.get, found) if i is not None)
                    ids.append(doc_id)
                    sizes.append(len(found))
                    terms.append(list(own))
                    counts.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, sizes, terms, counts), schema)], schema=schema)

    return docs.mapInArrow(run, ddl)


def _search(counted: DataFrame, tree: Node, most: np.ndarray, least: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best of each item in every task."""
    schema, ddl = arrow_schema(item="int", doc_id="long", score="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(tree, most, least, k)
        waiting: list[pa.RecordBatch] = []

        def flush() -> None:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            ids = whole["doc_id"].fill_null(LAST_ID).to_numpy()
            terms, counts = (np.concatenate([c.flatten().to_numpy() for c in whole[name].chunks] or [np.zeros(0, np.int32)]).astype(np.int64) for name in ("terms", "counts"))
            lengths = np.concatenate([c.value_lengths().to_numpy() for c in whole["terms"].chunks] or [np.zeros(0, np.int64)])
            owner = np.repeat(np.arange(len(ids)), lengths)
            m = 100 - 75 + 75 * whole["n"].to_numpy() * n_docs // n_terms
            search.add(ids, owner, terms, 1_000_000_000 * counts // (1000 * counts + 8 * m[owner]))

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= TOGETHER:
                flush()
        if waiting:
            flush()
        rows = [(i, -d, s) for i, heap in enumerate(search.best) for s, d in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([None if r[1] == LAST_ID else r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
            schema=schema,
        )

    return counted.select("doc_id", "n", "terms", "counts").mapInArrow(run, ddl)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item with their rank; equal scores by doc_id. A filter on row_number limits before each shuffle."""
    by_score = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*by_score))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by_score))).filter(F.col("rank") <= k).drop("salt")


def _block(counted_from: DataFrame, rows: list, k: int) -> DataFrame:
    """Results (item_id, rank, doc_id, score) for the items (item_id, text) of one block."""
    spark = counted_from.sparkSession
    texts = [Counter(terms_of((text or "").encode("utf-8"))) for _, text in rows]
    index = {t: i for i, t in enumerate(sorted({t for c in texts for t in c}))}
    counted = materialize(_count_terms(counted_from, index), "term-counts")
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(index), np.int64)
    for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row for each term of the items
        holding[term] = n
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)
    vectors = []
    for c in texts:
        own = np.array(sorted(index[t] for t in c), np.int64)
        by_index = {index[t]: n for t, n in c.items()}
        vectors.append((own, weight[own] * np.array([by_index[i] for i in own.tolist()], np.int64)))
    # Items with the same common terms, most often of one language, stand together.
    order = sorted(range(len(rows)), key=lambda i: tuple(sorted(vectors[i][0].tolist(), key=lambda t: -holding[t])[:3]))
    tree = item_tree([vectors[i] for i in order])
    most = np.zeros(max(1, len(index)), np.int64)
    most[tree.terms] = tree.most
    least = np.ones(len(rows), np.int64)
    parts = max(1, n_docs // SAMPLE)
    sampled = counted.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(parts)) == 0)
    weakest = _best(_search(sampled, tree, most, least, n_docs, n_terms, k), k).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    for item, low in weakest.filter(F.col("n") >= k).select("item", "least").collect():  # one row for each item of the block
        least[item] = max(low, 1)
    found = _best(_search(counted, tree, most, least, n_docs, n_terms, k), k)
    names = spark.createDataFrame([(at, rows[i][0]) for at, i in enumerate(order)], "item int, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = BEST, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents of each item, scores above 0 only.

    Null and empty texts have no terms: such a document counts nowhere and such an item has no rows. Equal scores
    stand by doc_id, rows without an id last. Repeated documents are documents of their own, repeated items get their
    own rows. A very long text is counted whole. Empty tables give no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    asked = items.select(F.col(item_column).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text IS NOT NULL")
    rows, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-rows // ITEMS), -(-size // ITEM_BYTES))
    out = None
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        own = [r for r in own if terms_of(r[1].encode("utf-8"))]
        if own:
            found = _block(texts, own, k)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
