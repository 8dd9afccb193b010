"""Suffix-array dedup: removes bytes covered by a string of ``length`` bytes that also starts earlier.

Sorting every suffix of the corpus is not needed to find its repeats. An anchor is a position whose gram has
the smallest hash among the grams of some window of ``length`` bytes; equal windows have their anchors in the
same places, so only suffixes at anchors are sorted, and only where an anchor's gram occurs more than once:

1. Grams of all anchors are counted; the repeated ones become Elias-Fano lists in the shared folder.
2. Around each anchor with a repeated gram, its context (every window that can hold the anchor) is sent to
   the shard of the gram. Equal contexts of a run of texts are sent once, with the earliest place.
3. A shard sorts, for each gram, the suffixes that start at the anchors, and the reversed prefixes that end there.
   It is a merge sort; two suffixes are compared through the length of their common prefix, found by binary
   search over prefix polynomial hashes. Common lengths of neighbours are verified byte by byte, and a group in
   which a hash lied is sorted again by its bytes. Two contexts share a window if they agree far enough to
   both sides, so the sorted lengths say which windows of a context also start earlier.
   A gram with more than ``hot`` different contexts is not sorted: each window around its anchors goes to the shard
   of its own 128-bit digest, where only the earliest place counts. So no task holds all surroundings of one gram.
   A sample of the contexts, taken by their hash, says which grams these are; either way gives the same result.
4. Each text looks up its anchors and marks the covered bytes. The steps are narrow: no text is shuffled.

The lists and results are memory-mapped, so the shared folder must be mounted on the executors.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectry.llm.common import arrow_schema, bound_batches, texts_as_bytes
from prospectry.llm.elias_fano import EliasFano, U, load, save
from prospectry.llm.ngram_lm import local_folder, pack, unpack
from prospectry.session import work_path

#: Window, bytes of a gram, bytes of text for each shard, and bytes that a task gathers before it sends.
LENGTH, GRAM, SHARD_BYTES, RUN_BYTES = 100, 32, 32 << 20, 2 << 20
#: Different contexts of a gram that one task may sort.
HOT = 50_000
#: Base of the polynomial hashes (modulo 2**64), and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
LAST_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Setup:
    folder: str
    shards: int
    length: int
    gram: int
    hot: int = HOT

    @property
    def sampled(self) -> int:
        """One context of so many is counted to find hot grams."""
        return max(1, min(64, self.hot // 16))

    @property
    def reach(self) -> int:
        """Farthest that an anchor can lie behind the start of its window."""
        return self.length - self.gram


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=3)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, U(BASE)), np.full(size, U(INVERSE))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of each run of ``width`` values: out[i] is that of x[i : i + width]."""
    n = len(x) - width + 1
    filled = np.concatenate([x, np.repeat(x[-1:], -len(x) % width)]).reshape(-1, width)
    ahead = best.accumulate(filled, axis=1).ravel()
    behind = best.accumulate(filled[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[width - 1 : width - 1 + n])


class Texts:
    """Some whole texts, one after another, with their prefix hashes and anchors."""

    def __init__(self, texts: list[bytes], setup: Setup) -> None:
        self.setup = setup
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.bytes)
        self.anchors = np.zeros(0, np.int64)
        if n < setup.length:
            return
        size = 1 << max(20, int(n + 1).bit_length())
        up, self.down = powers(size)
        self.hash = np.zeros(n + 1, U)
        np.cumsum((self.bytes.astype(U) + U(1)) * up[:n], out=self.hash[1:])
        grams = mix((self.hash[setup.gram :] - self.hash[: -setup.gram]) * self.down[: n - setup.gram + 1]) | U(1)
        width = setup.reach + 1
        least = slide(grams, width, np.minimum)  # of each window
        owner_end = np.repeat(self.ends, sizes)[: len(least)]
        least[np.arange(len(least)) + setup.length > owner_end] = 0  # windows that cross a text's end
        padded = np.concatenate([np.zeros(width - 1, U), least, np.zeros(width - 1, U)])
        chosen = np.flatnonzero(slide(padded, width, np.maximum) == grams)
        self.anchors = chosen
        self.grams = (grams[chosen] >> U(1)).astype(np.int64)
        self.doc = np.searchsorted(self.ends, chosen, "right")
        self.left = np.minimum(setup.reach, chosen - self.starts[self.doc])
        self.right = np.minimum(setup.length, self.ends[self.doc] - chosen)

    def keep(self, at: np.ndarray) -> None:
        for name in ("anchors", "grams", "doc", "left", "right"):
            setattr(self, name, getattr(self, name)[at])

    def context_keys(self) -> np.ndarray:
        """Hash of each anchor's gram and context."""
        first, last = self.anchors - self.left, self.anchors + self.right
        body = (self.hash[last] - self.hash[first]) * self.down[first]
        return (mix(body ^ mix(self.grams.astype(U) + self.left.astype(U) * U(0x632BE59BD9B4E019) + self.right.astype(U) * U(0x9FB21C651E98DF25))) >> U(1)).astype(np.int64)

    def contexts(self) -> np.ndarray:
        """Bytes around each anchor: ``reach`` before and ``length`` from it on, zero outside the text."""
        span = np.arange(-self.setup.reach, self.setup.length)
        at = self.anchors[:, None] + span
        inside = (span >= -self.left[:, None]) & (span < self.right[:, None])
        return np.where(inside, self.bytes[np.clip(at, 0, len(self.bytes) - 1)], 0).astype(np.uint8)


def runs(batches: Iterator[pa.RecordBatch], size: int = RUN_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and whole texts, about ``size`` bytes at a time."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1))):
            ids.append(LAST_ID if i is None else i)
            texts.append(t)
            held += len(t) + 1
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


@lru_cache(maxsize=4)
def lists(setup: Setup, name: str) -> dict[int, EliasFano | None]:
    return {}


def listed(setup: Setup, name: str, shard: int) -> EliasFano | None:
    opened = lists(setup, name)
    if shard not in opened:
        place = f"{setup.folder}/{name}-{shard}"
        opened[shard] = EliasFano.open(place, "keys") if os.path.exists(f"{place}/keys-zeros.npy") else None
    return opened[shard]


@lru_cache(maxsize=4096)
def results(setup: Setup, shard: int, name: str, kind: str = "contexts") -> np.ndarray:
    """One mapped array of a shard's contexts or windows."""
    return load(f"{setup.folder}/{kind}-{shard}", name)


def repeated_only(texts: Texts) -> None:
    """Keep the anchors whose gram is listed as repeated."""
    setup = texts.setup
    shard = texts.grams % setup.shards if len(texts.anchors) else np.zeros(0, np.int64)
    hit = np.zeros(len(texts.anchors), bool)
    for s in np.unique(shard):
        if (keys := listed(setup, "repeated", int(s))) is not None:
            own = np.flatnonzero(shard == s)
            hit[own] = keys.find(texts.grams[own] // setup.shards) >= 0
    if len(texts.anchors):
        texts.keep(np.flatnonzero(hit))


def hot_windows(texts: Texts) -> np.ndarray:
    """Takes out the anchors with a hot gram; gives where the windows around them start."""
    setup, hit = texts.setup, np.zeros(len(texts.anchors), bool)
    if not len(hit):
        return np.zeros(0, np.int64)
    shard = texts.grams % setup.shards
    for s in np.unique(shard):
        if (keys := listed(setup, "hot", int(s))) is not None:
            own = np.flatnonzero(shard == s)
            hit[own] = keys.find(texts.grams[own] // setup.shards) >= 0
    if not hit.any():
        return np.zeros(0, np.int64)
    near = np.zeros(len(texts.bytes), bool)
    for a, left, right in zip(texts.anchors[hit].tolist(), texts.left[hit].tolist(), texts.right[hit].tolist()):
        near[a - left : max(a - left, a + right - setup.length + 1)] = True
    texts.keep(np.flatnonzero(~hit))
    return np.flatnonzero(near)


def digests(texts: Texts, starts: np.ndarray) -> np.ndarray:
    """Two words for the 128-bit digest of each window."""
    data, length = texts.bytes.tobytes(), texts.setup.length
    made = b"".join(hashlib.blake2b(data[s : s + length], digest_size=16).digest() for s in starts.tolist())
    return np.frombuffer(made, ">u8").astype(U).reshape(-1, 2)


class Suffixes:
    """Strings of up to ``width`` bytes in groups, sorted inside each group by hash-compared merge sort."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> None:
        self.rows, self.sizes = rows, sizes
        n, width = rows.shape
        up = powers(1 << 20)[0]
        self.prefix = np.zeros((n, width + 1), U)
        np.cumsum((rows.astype(U) + U(1)) * up[:width], axis=1, out=self.prefix[:, 1:])
        first = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        self.group_start = np.repeat(first, np.diff(np.append(first, n)))
        self.group_end = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
        self.order = self._sorted()
        self.common = self._verified()

    def lcp(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of pairs of strings, by binary search over prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.sizes[a], self.sizes[b])
        while True:
            going = np.flatnonzero(low < high)
            if not len(going):
                return low
            middle = (low[going] + high[going] + 1) >> 1
            same = self.prefix[a[going], middle] == self.prefix[b[going], middle]
            low[going] = np.where(same, middle, low[going])
            high[going] = np.where(same, high[going], middle - 1)

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: whether string a comes before, with or after b."""
        k = self.lcp(a, b)
        ended_a, ended_b = k >= self.sizes[a], k >= self.sizes[b]
        at = np.minimum(k, self.rows.shape[1] - 1)
        bytes_differ = np.sign(self.rows[a, at].astype(np.int16) - self.rows[b, at].astype(np.int16))
        return np.where(ended_a | ended_b, ended_b.astype(np.int64) - ended_a, bytes_differ)

    def _sorted(self) -> np.ndarray:
        n = len(self.rows)
        order, place = np.arange(n), np.arange(n)
        inside = place - self.group_start
        longest = int((self.group_end - self.group_start).max(initial=0))
        run = 1
        while run < longest:
            # Every string finds how many of the neighbouring run go before it.
            mine = inside // run
            left = mine % 2 == 0
            low = np.where(left, self.group_start + (mine + 1) * run, self.group_start + (mine - 1) * run)
            high = np.minimum(low + run, self.group_end)
            low = np.minimum(low, self.group_end)
            start = low.copy()
            while True:
                going = np.flatnonzero(low < high)
                if not len(going):
                    break
                middle = (low[going] + high[going]) >> 1
                sign = self.before(order[middle], order[going])
                first = np.where(left[going], sign < 0, sign <= 0)
                low[going] = np.where(first, middle + 1, low[going])
                high[going] = np.where(first, high[going], middle)
            base = self.group_start + (mine - (mine % 2)) * run
            to = base + (place - (self.group_start + mine * run)) + (low - start)
            moved = np.empty_like(order)
            moved[to] = order
            order = moved
            run *= 2
        return order

    def _verified(self) -> np.ndarray:
        """Common prefix of each string in order with the one before it in its group (-1 for a group's first)."""
        def neighbours() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b = self.order[:-1], self.order[1:]
            same = self.group_start[:-1] == self.group_start[1:]
            common, differ = np.empty(len(a), np.int64), np.empty(len(a), bool)
            for at in range(0, len(a), 1 << 14):
                x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
                unequal = self.rows[x] != self.rows[y]
                limit = np.minimum(self.sizes[x], self.sizes[y])
                common[at : at + (1 << 14)] = np.minimum(np.where(unequal.any(1), unequal.argmax(1), unequal.shape[1]), limit)
                differ[at : at + (1 << 14)] = self.before(x, y) > 0
            return common, same, differ

        common, same, wrong = neighbours()
        lied = same & (wrong | (self.lcp(self.order[:-1], self.order[1:]) != common))
        if lied.any():
            for first in np.unique(self.group_start[:-1][lied]):
                last = self.group_end[first]
                own = self.order[first:last]
                self.order[first:last] = sorted(own.tolist(), key=lambda i: self.rows[i, : self.sizes[i]].tobytes())
            common, same, _ = neighbours()
        return np.concatenate([[-1], np.where(same, common, -1)])

    def classes(self, length: int) -> np.ndarray:
        """A number for each string, equal exactly for strings of a group that agree in ``length`` bytes."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.common < length)
        return out


def windows_seen(bytes_: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray, rank: np.ndarray, setup: Setup) -> np.ndarray:
    """Two words of bits for each context: bit k if the window that starts k bytes before the anchor starts earlier too.

    Contexts lie in order of ``group``; ``rank`` is the order of their first places.
    """
    reach, length = setup.reach, setup.length
    masks = np.zeros((len(left), 2), U)
    if not len(left):
        return masks
    ahead = Suffixes(np.ascontiguousarray(bytes_[:, reach:]), right, group)
    back = Suffixes(np.ascontiguousarray(bytes_[:, :reach][:, ::-1]), left, group)
    for k in range(reach + 1):
        some = np.flatnonzero((left >= k) & (right >= length - k))
        key = ahead.classes(length - k)[some] * (len(left) + 1) + back.classes(k)[some]
        order = np.lexsort((rank[some], key))
        later = np.concatenate([[False], key[order][1:] == key[order][:-1]])
        masks[some[order[later]], k >> 6] |= U(1) << U(k & 63)
    return masks


def _count_grams(setup: Setup):
    schema, ddl = arrow_schema(shard="int", keys="binary", counts="binary", grams="binary", contexts="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in runs(batches):
            texts = Texts(some, setup)
            if not len(texts.anchors):
                continue
            grams, counts = np.unique(texts.grams, return_counts=True)
            shard = grams % setup.shards
            contexts = texts.context_keys()
            some_of = np.flatnonzero(contexts % setup.sampled == 0)
            pairs = np.unique(np.stack([texts.grams[some_of], contexts[some_of]], 1), axis=0)
            home = pairs[:, 0] % setup.shards
            rows = [
                (int(s), pack(grams[shard == s] // setup.shards), pack(np.minimum(counts[shard == s], 2)), pack(pairs[home == s, 0] // setup.shards), pack(pairs[home == s, 1]))
                for s in np.unique(shard)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([unpack(x) for x in rows["keys"]])
        counts = np.concatenate([unpack(x) for x in rows["counts"]]).astype(np.int64)
        grams, back = np.unique(keys, return_inverse=True)
        shard = int(rows["shard"].iloc[0])
        EliasFano.of(grams[np.bincount(back, counts) >= 2]).save(f"{setup.folder}/repeated-{shard}", "keys")
        pairs = np.unique(np.stack([np.concatenate([unpack(x) for x in rows[name]]) for name in ("grams", "contexts")], 1), axis=0)
        grams, counts = np.unique(pairs[:, 0], return_counts=True)
        if (counts * setup.sampled > setup.hot).any():
            EliasFano.of(grams[counts * setup.sampled > setup.hot]).save(f"{setup.folder}/hot-{shard}", "keys")
        return pd.DataFrame({"shard": [shard]})

    return run, ddl, gather


def _send_contexts(setup: Setup):
    schema, ddl = arrow_schema(shard="int", grams="binary", keys="binary", left="binary", right="binary", docs="binary", places="binary", bytes="binary")

    def windows(texts: Texts, starts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        """The two earliest places of each window, for shards after those of the grams."""
        made = digests(texts, starts)
        doc = np.searchsorted(texts.ends, starts, "right")
        docs, places = ids[doc], starts - texts.starts[doc]
        order = np.lexsort((places, docs, made[:, 1], made[:, 0]))
        third = np.zeros(len(order), bool)
        third[2:] = (made[order][2:] == made[order][:-2]).all(1)
        order = order[~third]
        shard = (made[order, 1] % U(setup.shards)).astype(np.int64)
        rows = []
        for s in np.unique(shard):
            own = order[shard == s]
            rows.append((setup.shards + int(s), b"", pack(made[own, 0]), b"", b"", pack(docs[own]), pack(places[own]), made[own, 1].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def gather_windows(rows: pd.DataFrame) -> pd.DataFrame:
        high, docs, places = (np.concatenate([unpack(x) for x in rows[name]]) for name in ("keys", "docs", "places"))
        low = np.frombuffer(b"".join(rows["bytes"]), U)
        docs, places = docs.astype(np.int64), places.astype(np.int64)
        order = np.lexsort((places, docs, low, high))
        high, low, docs, places = high[order], low[order], docs[order], places[order]
        same = (high[1:] == high[:-1]) & (low[1:] == low[:-1])
        first = np.flatnonzero(np.concatenate([[True], ~same]) & np.append(same, False))  # of those that occur twice
        shard = int(rows["shard"].iloc[0]) - setup.shards
        both = np.stack([high[first], low[first]], 1).astype(">u8")
        for name, value in (("digests", np.ascontiguousarray(both).view("S16").ravel()), ("docs", docs[first]), ("places", places[first])):
            save(f"{setup.folder}/windows-{shard}", name, value)
        return pd.DataFrame({"shard": [shard]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, some in runs(batches):
            texts = Texts(some, setup)
            repeated_only(texts)
            starts = hot_windows(texts)
            if len(starts):
                yield windows(texts, starts, np.array(ids, np.int64))
            if not len(texts.anchors):
                continue
            docs = np.array(ids, np.int64)[texts.doc]
            places = texts.anchors - texts.starts[texts.doc]
            keys = texts.context_keys()
            order = np.lexsort((places, docs, keys))
            order = order[np.concatenate([[True], keys[order][1:] != keys[order][:-1]])]
            texts.keep(order)
            keys, docs, places, shard = keys[order], docs[order], places[order], texts.grams % setup.shards
            content = texts.contexts()
            rows = []
            for s in np.unique(shard):
                own = np.flatnonzero(shard == s)
                own = own[np.argsort(texts.grams[own], kind="stable")]
                rows.append((
                    int(s), pack(texts.grams[own]), pack(keys[own]), pack(texts.left[own]), pack(texts.right[own]), pack(docs[own]), pack(places[own]),
                    pa.compress(content[own].tobytes(), codec="zstd", asbytes=True),
                ))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["shard"].iloc[0] >= setup.shards:
            return gather_windows(rows)
        grams, keys, left, right, docs, places = (
            np.concatenate([unpack(x) for x in rows[name]]).astype(np.int64) for name in ("grams", "keys", "left", "right", "docs", "places")
        )
        width = setup.reach + setup.length
        parts = [unpack(x).shape[0] for x in rows["grams"]]
        content = np.concatenate([
            np.frombuffer(pa.decompress(x, decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8).reshape(n, width) for x, n in zip(rows["bytes"], parts)
        ])
        order = np.lexsort((places, docs, keys, grams))
        same = (keys[order][1:] == keys[order][:-1]) & (grams[order][1:] == grams[order][:-1])
        pairs = np.flatnonzero(same)
        for at in range(0, len(pairs), 1 << 14):
            here = pairs[at : at + (1 << 14)]
            if (content[order[here]] != content[order[here + 1]]).any():
                raise ValueError("two contexts share a 63-bit hash: choose another gram length")
        order = order[np.concatenate([[True], ~same])]
        grams, keys, left, right, docs, places, content = (x[order] for x in (grams, keys, left, right, docs, places, content))
        rank = np.empty(len(grams), np.int64)
        rank[np.lexsort((places, docs))] = np.arange(len(grams))
        masks = np.zeros((len(grams), 2), U)
        first = np.flatnonzero(np.diff(grams, prepend=-1))
        sizes = np.diff(np.append(first, len(grams)))
        # Groups of two contexts or more, some thousand contexts at a time.
        many = np.flatnonzero(np.repeat(sizes, sizes) > 1)
        cut = np.flatnonzero(np.diff(grams[many], prepend=-1))
        at = 0
        while at < len(many):
            after = np.searchsorted(cut, at + 20_000)
            end = int(cut[after]) if after < len(cut) else len(many)
            own = many[at:end]
            masks[own] = windows_seen(content[own], left[own], right[own], grams[own], rank[own], setup)
            at = end
        shard = int(rows["shard"].iloc[0])
        place = f"{setup.folder}/contexts-{shard}"
        by_key = np.argsort(keys, kind="stable")
        if (np.diff(keys[by_key]) == 0).any():
            raise ValueError("two contexts share a 63-bit hash: choose another gram length")
        for name, value in (("docs", docs), ("places", places), ("masks", masks)):
            save(place, name, value[by_key])
        EliasFano.of(keys[by_key]).save(place, "keys")
        return pd.DataFrame({"shard": [shard]})

    return run, ddl, gather


def covered(texts: Texts, ids: np.ndarray) -> np.ndarray:
    """Whether each byte is covered by a window that also starts earlier."""
    setup = texts.setup
    n = len(texts.bytes)
    firsts, lasts = [], []

    def mark(first: np.ndarray, last: np.ndarray) -> None:
        firsts.append(first)
        lasts.append(last)

    repeated_only(texts)
    starts = hot_windows(texts)
    if len(starts):
        made = digests(texts, starts)
        doc = np.searchsorted(texts.ends, starts, "right")
        home = (made[:, 1] % U(setup.shards)).astype(np.int64)
        names = np.ascontiguousarray(made.astype(">u8")).view("S16").ravel()
        for s in np.unique(home):
            known = results(setup, int(s), "digests", "windows")
            if not len(known):
                continue
            own = np.flatnonzero(home == s)
            at = np.minimum(np.searchsorted(known, names[own]), len(known) - 1)
            own, at = own[known[at] == names[own]], at[known[at] == names[own]]
            differs = (results(setup, int(s), "docs", "windows")[at] != ids[doc[own]]) | (results(setup, int(s), "places", "windows")[at] != starts[own] - texts.starts[doc[own]])
            mark(starts[own[differs]], starts[own[differs]] + setup.length)
    if not len(texts.anchors) and not firsts:
        return np.zeros(n, bool)
    keys, shard = texts.context_keys(), texts.grams % setup.shards
    first_doc, first_place, masks = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros((len(keys), 2), U)
    for s in np.unique(shard):
        own = np.flatnonzero(shard == s)
        at = listed(setup, "contexts", int(s)).find(keys[own])
        if (at < 0).any():
            raise ValueError("a context is missing: the texts have changed since they were counted")
        first_doc[own], first_place[own], masks[own] = (results(setup, int(s), name)[at] for name in ("docs", "places", "masks"))
    later = (ids[texts.doc] != first_doc) | (texts.anchors - texts.starts[texts.doc] != first_place)
    some = np.flatnonzero(later & (texts.left + texts.right >= setup.length))
    # All windows of a context that has been before.
    mark(texts.anchors[some] - texts.left[some], texts.anchors[some] - np.maximum(0, setup.length - texts.right[some]) + setup.length)
    rest = np.flatnonzero(~later & masks.any(1))
    for k in range(setup.reach + 1):
        hit = rest[(masks[rest, k >> 6] >> U(k & 63)) & U(1) == 1]
        if len(hit):
            mark(texts.anchors[hit] - k, texts.anchors[hit] - k + setup.length)
    change = np.bincount(np.concatenate(firsts), minlength=n + 1) - np.bincount(np.concatenate(lasts), minlength=n + 1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES,
    digests_only: bool = False, hot: int = HOT,
) -> DataFrame:
    """doc_id, n_bytes, spans (first byte and end of each removed run, one after another), kept (bytes) of each row.

    Earlier means a smaller id, or the same text at a smaller place. Null and empty texts have no bytes. Rows
    without an id come after all others and keep a null id. Rows that share an id are neither
    earlier than the other at the same place, so repeated rows with one id keep their bytes. An empty table gives no rows;
    further columns are ignored. With ``digests_only``: n_removed, n_spans and kept_sha256 in place of spans and kept.
    """
    if not 0 < gram <= length or length - gram > 127:
        raise ValueError("the window may be at most 127 bytes longer than the gram")
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    setup = Setup(local_folder(work_path(spark, "suffixes")), max(1, -(-size // shard_bytes)), length, gram, hot)
    for step in (_count_grams, _send_contexts):
        run, ddl, gather = step(setup)
        docs.mapInArrow(run, ddl).groupBy("shard").applyInPandas(gather, "shard int").collect()  # one number for each shard
    kinds = {"n_removed": "long", "n_spans": "long", "kept_sha256": "string"} if digests_only else {"spans": "array<long>", "kept": "binary"}
    schema, ddl = arrow_schema(doc_id="long", n_bytes="long", **kinds)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, some in runs(batches):
            texts = Texts(some, setup)
            gone = covered(texts, np.array(ids, np.int64))
            columns: list[list] = [[None if i == LAST_ID else i for i in ids], (texts.ends - texts.starts).tolist(), *([] for _ in kinds)]
            for a, b in zip(texts.starts.tolist(), texts.ends.tolist()):
                own = gone[a:b]
                edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
                kept = texts.bytes[a:b][~own].tobytes()
                for column, value in zip(columns[2:], (int(own.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()) if digests_only else (edges.tolist(), kept)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.mapInArrow(apply, ddl)
