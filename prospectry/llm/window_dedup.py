"""Substring dedup over words: removes words covered by a window of ``window`` words that also starts in an earlier document.

Windows travel as super-k-mers. A window's minimiser is the least hash among its runs of ``gram`` words; equal windows
have equal minimisers, and consecutive windows with one minimiser are sent as one packed string to its bucket:

1. Minimisers of all windows are counted; those of a single document hold no repeat and need no bucket.
2. Each run of texts sends the super-k-mers of the other minimisers, equal ones once, with the first document
   that holds them. A bucket gives its words numbers and sorts the windows by them, so equal windows are found
   by content, and notes which windows of a super-k-mer start in an earlier document than the string itself.
   A minimiser with more than ``crowded`` different super-k-mers is dealt again by a minimiser as long as the window:
   there a super-k-mer is one window, sent at most once by each run, so no bucket holds all surroundings of a common line.
3. Each text looks up its super-k-mers and marks the covered words. The steps are narrow: no text is shuffled.

Super-k-mers are named by 128-bit digests when they are sent once and looked up. Lists and results are
memory-mapped, so the shared folder must be mounted on the executors.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectry.llm.common import arrow_schema, bound_batches
from prospectry.llm.elias_fano import EliasFano, U, load, save
from prospectry.llm.ngram_lm import local_folder, pack, unpack
from prospectry.llm.suffix_dedup import LAST_ID, mix, powers, runs, slide
from prospectry.session import work_path

#: Words of a window and of a minimiser, bytes of text for each bucket, and super-k-mers of a minimiser that one bucket sorts.
WINDOW, GRAM, BUCKET_BYTES, CROWDED = 13, 5, 16 << 20, 20_000
#: Windows of one super-k-mer, as many as its mask has bits.
LONGEST = 32


@dataclass(frozen=True)
class Setup:
    folder: str
    buckets: int
    window: int
    gram: int
    crowded: int


class Words:
    """The words of some whole texts, one after another, with the windows' super-k-mers."""

    def __init__(self, texts: list[bytes], setup: Setup) -> None:
        self.setup = setup
        split = [t.split() for t in texts]  # bytes are split at the six ASCII white-space characters
        sizes = np.array([len(s) for s in split], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        words = [w for s in split for w in s]
        self.joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.after = np.cumsum(lengths)  # first byte of the next word
        self.begin = self.after - lengths
        n = len(words)
        self.first = np.zeros(0, np.int64)
        if n < setup.window:
            return
        number: dict[bytes, int] = {}
        codes = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        of_word = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, number)), U).reshape(-1, 2)
        up, self.down = powers(1 << max(20, int(n + 1).bit_length()))
        self.sums = np.zeros((2, n + 1), U)
        for k in range(2):
            np.cumsum(of_word[codes, k] * up[:n], out=self.sums[k, 1:])
        last_start = np.repeat(self.ends, sizes)[: n - setup.window + 1] - setup.window
        valid = np.flatnonzero(np.arange(n - setup.window + 1) <= last_start)
        if not len(valid):
            return
        grams = self.hashes(0, np.arange(n - setup.gram + 1), setup.gram)
        least = slide(grams, setup.window - setup.gram + 1, np.minimum)[valid]
        self._cut(valid, (least >> U(1)).astype(np.int64))

    def _cut(self, starts: np.ndarray, keys: np.ndarray) -> None:
        """Super-k-mers: runs of consecutive windows with one key."""
        new = np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(keys) != 0)])
        head = np.flatnonzero(new)
        place = np.arange(len(starts)) - np.repeat(head, np.diff(np.append(head, len(starts))))
        head = np.flatnonzero(place % LONGEST == 0)
        self.first, self.keys, self.count = starts[head], keys[head], np.diff(np.append(head, len(starts)))
        self.level = np.zeros(len(head), np.int64)
        self._name()

    def _name(self) -> None:
        self.doc = np.searchsorted(self.ends, self.first, "right")
        words = self.count + self.setup.window - 1
        self.digest = np.stack([self.hashes(k, self.first, words) ^ mix(words.astype(U)) for k in range(2)], 1)

    def hashes(self, k: int, first: np.ndarray, words: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[k, first + words] - self.sums[k, first]) * self.down[first])

    def keep(self, at: np.ndarray) -> None:
        for name in ("first", "keys", "count", "level", "doc", "digest"):
            setattr(self, name, getattr(self, name)[at])

    def bucket(self) -> np.ndarray:
        return self.level * self.setup.buckets + self.keys % self.setup.buckets

    def choose(self) -> None:
        """Keep what can repeat: super-k-mers of shared minimisers, and each window of a crowded one by itself."""
        if not len(self.first):
            return
        shared, crowded = (self._listed(name) for name in ("shared", "crowded"))
        wide = np.flatnonzero(crowded)
        single = np.repeat(self.first[wide], self.count[wide]) + np.concatenate([np.arange(c) for c in self.count[wide]] or [[]]).astype(np.int64)
        self.keep(np.flatnonzero(shared & ~crowded))
        if len(single):
            keys = (self.hashes(0, single, self.setup.window) >> U(1)).astype(np.int64)
            for name, more in (("first", single), ("keys", keys), ("count", np.ones(len(single), np.int64)), ("level", np.ones(len(single), np.int64))):
                setattr(self, name, np.concatenate([getattr(self, name), more]))
            self._name()

    def _listed(self, name: str) -> np.ndarray:
        hit = np.zeros(len(self.keys), bool)
        home = self.keys % self.setup.buckets
        order = np.argsort(home, kind="stable")
        edges = np.flatnonzero(np.diff(home[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            own = order[a:b]
            if (keys := listed(self.setup, name, int(home[own[0]]))) is not None:
                hit[own] = keys.find(self.keys[own] // self.setup.buckets) >= 0
        return hit

    def distinct(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One of each group of equal super-k-mers, by bucket and digest, with the first and last document that hold it."""
        home, docs = self.bucket(), ids[self.doc]
        order = np.lexsort((docs, self.digest[:, 1], self.digest[:, 0], home))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(home[order]) != 0) | (np.diff(self.digest[order], axis=0) != 0).any(1)]))
        last = np.append(new[1:], len(order)) - 1
        return order[new], docs[order[new]], docs[order[last]]

    def packed(self, at: np.ndarray) -> bytes:
        """The words of super-k-mers, one after another."""
        a, b = self.begin[self.first[at]].tolist(), self.after[self.first[at] + self.count[at] + self.setup.window - 2].tolist()
        return b" ".join([self.joined[i : j - 1] for i, j in zip(a, b)])


@lru_cache(maxsize=4)
def lists(setup: Setup, name: str) -> dict[int, EliasFano | None]:
    return {}


def listed(setup: Setup, name: str, bucket: int) -> EliasFano | None:
    opened = lists(setup, name)
    if bucket not in opened:
        place = f"{setup.folder}/{name}-{bucket}"
        opened[bucket] = EliasFano.open(place, "keys") if os.path.exists(f"{place}/keys-zeros.npy") else None
    return opened[bucket]


@lru_cache(maxsize=4096)
def results(setup: Setup, bucket: int, name: str) -> np.ndarray | None:
    place = f"{setup.folder}/bucket-{bucket}"
    return load(place, name) if os.path.exists(f"{place}/{name}.npy") else None


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _per_bucket(blocks: DataFrame, gather, setup: Setup) -> None:
    """Run ``gather`` on the rows of each bucket; twice as many partitions as buckets, so that few tasks get two large ones."""
    dealt = blocks.repartition(2 * setup.buckets, "bucket")
    dealt.groupBy("bucket").applyInPandas(gather, "bucket int").agg(F.count(F.lit(1))).first()


def count_minimisers(docs: DataFrame, setup: Setup) -> None:
    """Lists the minimisers of two documents or more, and the crowded ones among them."""
    schema, ddl = arrow_schema(bucket="int", keys="binary", docs="binary", more="binary", strings="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, some in runs(batches):
            words = Words(some, setup)
            if not len(words.first):
                continue
            at, first, last = words.distinct(np.array(ids, np.int64))
            home, keys = words.bucket()[at], words.keys[at]
            order = np.lexsort((keys, home))
            home, keys, first, last = home[order], keys[order], first[order], last[order]
            new = np.flatnonzero(np.diff(keys, prepend=-1))
            low, high, strings = np.minimum.reduceat(first, new), np.maximum.reduceat(last, new), np.diff(np.append(new, len(keys)))
            home, keys = home[new], keys[new]
            edges = np.flatnonzero(np.diff(home, prepend=-1, append=-1))
            cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
            yield _rows(schema, [(int(home[a]), pack(keys[a:b] // setup.buckets), pack(low[a:b]), pack(high[a:b] - low[a:b]), pack(strings[a:b])) for a, b in cuts])

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["bucket"].iloc[0])
        keys, low, more, strings = (np.concatenate([unpack(x) for x in rows[name]]).astype(np.int64) for name in ("keys", "docs", "more", "strings"))
        order = np.argsort(keys, kind="stable")
        keys, low, high, strings = keys[order], low[order], (low + more)[order], strings[order]
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, low, high, strings = keys[new], np.minimum.reduceat(low, new), np.maximum.reduceat(high, new), np.add.reduceat(strings, new)
        shared = low < high
        for name, chosen in (("shared", shared), ("crowded", shared & (strings > setup.crowded))):
            if chosen.any():
                EliasFano.of(keys[chosen]).save(f"{setup.folder}/{name}-{bucket}", "keys")
        return pd.DataFrame({"bucket": [bucket]})

    _per_bucket(docs.mapInArrow(run, ddl), gather, setup)


def equal_windows(texts: bytes, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, number) of each window of packed strings of so many words; equal numbers mean equal words.

    Words are numbered, then sorted runs of 2, 4, 8 .. words, each as a pair of runs of half the length.
    """
    number: dict[bytes, int] = {}
    rank = np.array([number.setdefault(w, len(number)) for w in texts.split(b" ")], np.int64)
    length = 1
    while length < window:
        step = min(length, window - length)
        _, rank = np.unique(rank[:-step] << 32 | rank[step:], return_inverse=True)  # fewer than 2**32 words
        length += step
    counts = words - window + 1
    string = np.repeat(np.arange(len(words)), counts)
    begin = np.cumsum(words) - words
    at = np.arange(len(string)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin, counts)
    return string, rank[at]


def sort_buckets(docs: DataFrame, setup: Setup) -> None:
    """Writes, for each super-k-mer that matters, its first document and the windows that start in an earlier one."""
    schema, ddl = arrow_schema(bucket="int", digests="binary", counts="binary", docs="binary", more="binary", size="long", words="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, some in runs(batches):
            words = Words(some, setup)
            words.choose()
            if not len(words.first):
                continue
            at, first, last = words.distinct(np.array(ids, np.int64))
            home = words.bucket()[at]
            edges = np.flatnonzero(np.diff(home, prepend=-1, append=-1))
            rows = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                text = words.packed(at[a:b])
                rows.append((
                    int(home[a]), words.digest[at[a:b]].astype(">u8").tobytes(), pack(words.count[at[a:b]]), pack(first[a:b]), pack(last[a:b] - first[a:b]),
                    len(text), pa.compress(text, codec="zstd", asbytes=True),
                ))
            yield _rows(schema, rows)

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["bucket"].iloc[0])
        digests = np.frombuffer(b"".join(rows["digests"]), "S16")
        counts, low, more = (np.concatenate([unpack(x) for x in rows[name]]).astype(np.int64) for name in ("counts", "docs", "more"))
        text = b" ".join([pa.decompress(x, decompressed_size=n, codec="zstd", asbytes=True) for x, n in zip(rows["words"], rows["size"])])
        high = low + more
        string, number = equal_windows(text, counts + setup.window - 1, setup.window)
        # The first document of each window, over all strings that hold it.
        first = np.full(int(number.max()) + 1, LAST_ID)
        np.minimum.at(first, number, low[string])
        # Equal strings of several runs are one string.
        order = np.lexsort((low, digests))
        new = np.flatnonzero(np.concatenate([[True], digests[order][1:] != digests[order][:-1]]))
        low_of, high_of = low[order[new]], np.maximum.reduceat(high[order], new)
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
        begin = np.cumsum(counts) - counts
        bit = U(1) << (np.arange(len(string)) - begin[string]).astype(U)
        earlier = first[number] < low_of[group[string]]
        masks = np.zeros(len(new), U)
        np.bitwise_or.at(masks, group[string[earlier]], bit[earlier])
        some = np.flatnonzero((masks != 0) | (high_of > low_of))
        if len(some):
            for name, value in (("docs", low_of[some]), ("masks", masks[some]), ("digests", digests[order[new]][some])):
                save(f"{setup.folder}/bucket-{bucket}", name, value)
        return pd.DataFrame({"bucket": [bucket]})

    _per_bucket(docs.mapInArrow(run, ddl), gather, setup)


def covered(words: Words, ids: np.ndarray) -> np.ndarray:
    """Whether each word is covered by a window that also starts in an earlier document."""
    setup, n = words.setup, len(words.after)
    words.choose()
    change = np.zeros(n + 1, np.int64)
    if not len(words.first):
        return np.zeros(n, bool)
    names = np.ascontiguousarray(words.digest.astype(">u8")).view("S16").ravel()
    home = words.bucket()
    order = np.argsort(home, kind="stable")
    edges = np.flatnonzero(np.diff(home[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        known = results(setup, int(home[order[a]]), "digests")
        if known is None:
            continue
        own = order[a:b]
        at = np.minimum(np.searchsorted(known, names[own]), len(known) - 1)
        own, at = own[known[at] == names[own]], at[known[at] == names[own]]
        later = results(setup, int(home[order[a]]), "docs")[at] != ids[words.doc[own]]
        # Every window of a string that an earlier document holds; else those that other strings hold.
        masks = np.where(later, ~U(0), results(setup, int(home[order[a]]), "masks")[at])
        for k in range(int(words.count[own].max(initial=0))):
            hit = own[(words.count[own] > k) & ((masks >> U(k)) & U(1) == 1)]
            np.add.at(change, words.first[hit] + k, 1)
            np.add.at(change, words.first[hit] + k + setup.window, -1)
    return np.cumsum(change[:-1]) > 0


def remove_windows(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES,
    crowded: int = CROWDED, digests_only: bool = False,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by a space) of each row.

    Earlier means a smaller id; rows that share an id remove nothing from each other, so repeated rows keep their
    words. Rows without an id come after all others, and keep a null id. Null, empty and short texts lose nothing. A very long text is
    taken whole by one task. An empty table gives no rows; further columns are ignored. With ``digests_only``,
    kept_sha256 in place of kept.
    """
    if not 0 < gram <= window:
        raise ValueError("a minimiser is at most as long as the window")
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    setup = Setup(local_folder(work_path(spark, "windows")), max(1, -(-size // bucket_bytes)), window, gram, crowded)
    count_minimisers(docs, setup)
    sort_buckets(docs, setup)
    schema, ddl = arrow_schema(doc_id="long", n_words="long", n_removed="long", **{"kept_sha256" if digests_only else "kept": "string"})

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, some in runs(batches):
            words = Words(some, setup)
            gone = covered(words, np.array(ids, np.int64))
            rows = []
            for doc_id, a, b in zip(ids, words.starts.tolist(), words.ends.tolist()):
                edges = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=1, append=1)) + a  # of the runs that stay
                kept = b" ".join([words.joined[words.begin[i] : words.after[j - 1] - 1] for i, j in zip(edges[::2].tolist(), edges[1::2].tolist())])
                text = hashlib.sha256(kept).hexdigest() if digests_only else kept.decode("utf-8")
                rows.append((None if doc_id == LAST_ID else doc_id, b - a, int(gone[a:b].sum()), text))
            yield _rows(schema, rows)

    return docs.mapInArrow(apply, ddl)
