"""Language model scoring with an Elias-Fano n-gram trie.

Building counts the training corpus in three passes (words, pairs, triples). A task counts a run of its texts in
numpy and sends each shard one packed block of sorted keys and counts, so common n-grams shrink before the
shuffle; a shard adds up its blocks. Which shard holds an n-gram is a hash of its first two words, so no
context can fill one. Pairs and triples seen ``least`` times or more are kept; the registered query keeps all of
them. A shard is a small trie:

* contexts: Elias-Fano list of the first words that occur in the shard;
* pointers: Elias-Fano list of where each context's successors begin;
* successors: word ids made increasing by adding the last value of the context before; searched relative to that;
* one byte for each smoothed probability (interpolated absolute discounting) and for each backoff weight.

Shards are written to the shared folder and memory-mapped by the scoring tasks, which read only what they touch.
Words are known by the rank of their 64-bit hash, itself an Elias-Fano list. The shared folder must be
mounted on the executors (a file path), since files of another kind cannot be memory-mapped.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectry.llm.common import arrow_schema, bound_batches
from prospectry.llm.elias_fano import EliasFano, U, load, narrow, save
from prospectry.session import brief_shuffles, materialize, work_path

#: Bytes of training text for each shard, words that a counting task gathers before it sends, words remembered.
SHARD_BYTES, RUN_WORDS, REMEMBERED = 16 << 20, 1 << 20, 300_000
#: Least count of pairs and triples unless the caller names one, discount, and steps of a stored logarithm (base 10) for each unit.
LEAST, DISCOUNT, STEPS = 1, 0.75, 24
#: Tokens that are scored at once; a longer batch goes in pieces.
PIECE = 1_000_000
END = b""
BLOCKS = "shard int, part int, keys binary, more binary, counts binary"


def local_folder(uri: str) -> str:
    """The path of a mounted folder."""
    if uri.startswith("file:"):
        return "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        raise ValueError(f"the model's shards are memory-mapped: spark.checkpoint.dir must be a mounted folder, not {uri}")
    return uri


def word_hash(word: bytes) -> int:
    """63-bit hash of a word; the end of a text is the empty word."""
    return xxhash.xxh64_intdigest(word, 17) >> 1


def words_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def split_words(column: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Words of all texts of a string column without their ends: number of each among the distinct ones, these, and how many each text has."""
    texts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    flat = texts.flatten().dictionary_encode()
    number, distinct = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    counts = texts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if b"" in distinct:  # beside blanks at the ends of a text, which separate no words
        real = number != distinct.index(b"")
        kept = np.concatenate([[0], np.cumsum(real)])
        ends = np.cumsum(counts)
        number, counts = number[real], kept[ends] - kept[ends - counts]
    return number, distinct, counts


def pair_shard(first: np.ndarray, second: np.ndarray, shards: int) -> np.ndarray:
    x = first.astype(U) * U(0x9E3779B97F4A7C15) ^ second.astype(U) * U(0xC2B2AE3D27D4EB4F)
    return ((x * U(0x165667B19E3779F9)) >> U(33)).astype(np.int64) % shards


def pack(values: np.ndarray) -> bytes:
    """Sorted or small integers: differences, byte planes, Zstandard."""
    if not len(values):
        return b""
    steps = np.diff(values.astype(U), prepend=U(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, U)
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel(), dtype=U)


def squeeze(values: np.ndarray) -> bytes:
    """Numbers, none negative, in the smallest type that holds them, Zstandard; the type's size goes before."""
    values = narrow(values)
    return len(values).to_bytes(8, "little") + bytes([values.itemsize]) + pa.compress(np.ascontiguousarray(values), codec="zstd", asbytes=True) if len(values) else b""


def widen(data: bytes) -> np.ndarray:
    """What ``squeeze`` was given."""
    if not data:
        return np.zeros(0, np.uint8)
    n, size = int.from_bytes(data[:8], "little"), data[8]
    return np.frombuffer(pa.decompress(data[9:], decompressed_size=n * size, codec="zstd", asbytes=True), f"<u{size}")


def merged(keys: np.ndarray, more: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (two parts) in order, with the counts of equal ones added."""
    if not len(keys):
        return keys, more, counts
    order = np.lexsort((more, keys)) if more.any() else np.argsort(keys, kind="stable")
    keys, more = keys[order], more[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])]))
    return keys[first], more[first], np.add.reduceat(counts[order], first)


def _send(keys: np.ndarray, more: np.ndarray, counts: np.ndarray, shard: np.ndarray, ordered: bool = False) -> dict[str, list]:
    """Rows of BLOCKS: one for each shard that gets something. ``ordered``: keys are distinct and in order already."""
    rows: dict[str, list] = {k: [] for k in ("shard", "part", "keys", "more", "counts")}
    order = np.argsort(shard, kind="stable")
    names, first = np.unique(shard[order], return_index=True)
    for s, own in zip(names, np.split(order, first[1:])):
        k, m, c = (keys[own], more[own], counts[own]) if ordered else merged(keys[own], more[own], counts[own])
        for name, value in (("shard", int(s)), ("part", 0), ("keys", pack(k)), ("more", pack(m)), ("counts", pack(c))):
            rows[name].append(value)
    return rows


def _joined(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [[unpack(x) for x in rows[name]] for name in ("keys", "more", "counts")]
    more = [m if len(m) else np.zeros(len(k), U) for k, m in zip(parts[0], parts[1])]
    return merged(np.concatenate(parts[0]), np.concatenate(more), np.concatenate(parts[2]).astype(np.int64))


@dataclass(frozen=True)
class Model:
    folder: str
    shards: int
    starts: tuple[int, ...]  # rank of the first word of each vocabulary shard
    tokens: int
    distinct: int


def filter_place(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    x = (first.astype(U) + U(1)) * U(0xD6E8FEB86659FD93) ^ (second.astype(U) + U(1)) * U(0xA0761D6478BD642F)
    return ((((x ^ (x >> U(32))) * U(0xE7037ED1A0B428DB) >> U(32)) * U(size)) >> U(32)).astype(np.int64)


def filter_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Bit set with 8 bits for each kept n-gram; an n-gram whose bit is unset is not kept."""
    size = 8 * max(8, len(first))
    out = np.zeros(size, bool)
    out[filter_place(first, second, size)] = True
    return np.packbits(out, bitorder="little")


def may_hold(bitset: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    at = filter_place(first, second, len(bitset) * 8)
    return (bitset[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that occurs, and its places in order."""
    order, sizes = np.argsort(narrow(shard), kind="stable"), np.bincount(shard)
    names = np.flatnonzero(sizes)
    return zip(names.tolist(), np.split(order, np.cumsum(sizes[names])[:-1]))


class Reader:
    """Memory-mapped shards of one model, and the ids of the words met last."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.ids: dict[bytes, int] = {}
        self.starts = np.array(model.starts, np.int64)
        self.opened: dict[str, object] = {}

    def _list(self, shard: str, name: str) -> EliasFano:
        key = f"{shard}/{name}"
        if key not in self.opened:
            self.opened[key] = EliasFano.open(os.path.join(self.model.folder, shard), name)
        return self.opened[key]

    def _array(self, shard: str, name: str) -> np.ndarray:
        key = f"{shard}/{name}"
        if key not in self.opened:
            self.opened[key] = load(os.path.join(self.model.folder, shard), name)
        return self.opened[key]

    def word_ids(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word in the vocabulary, or -1."""
        new = [w for w in dict.fromkeys(words) if w not in self.ids]
        if new:
            if len(self.ids) + len(new) > REMEMBERED:
                self.ids = {}
                new = list(dict.fromkeys(words))
            hashes = np.array([word_hash(w) for w in new], np.int64)
            found = np.full(len(new), -1, np.int64)
            shard = hashes % self.model.shards
            for s, own in by_shard(shard):
                place = self._list(f"words-{s}", "hash").find(hashes[own] // self.model.shards)
                found[own] = np.where(place >= 0, place + self.starts[s], -1)
            self.ids.update(zip(new, found.tolist()))
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def of_words(self, ids: np.ndarray, name: str) -> np.ndarray:
        """A number kept for each word id (all known)."""
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.starts, ids, "right") - 1
        for s, own in by_shard(shard):
            out[own] = self._array(f"words-{s}", name)[ids[own] - self.starts[s]]
        return out

    @staticmethod
    def _children(pointers: EliasFano, successors: EliasFano, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of ``word`` among the successors of each node, or -1."""
        # Where a node's successors lie is looked up once for a run of equal nodes.
        new = np.diff(node, prepend=-1) != 0
        one, back = np.flatnonzero(new), np.cumsum(new) - 1
        begin, end = pointers.neighbours(node[one])
        base, first = np.zeros(len(one), np.int64), np.full(len(one), -1, np.int64)
        after = np.flatnonzero((begin > 0) & (end > begin))
        base[after], first[after] = successors.neighbours(begin[after] - 1)
        at_start = np.flatnonzero((begin == 0) & (end > 0))
        first[at_start] = successors.access(begin[at_start])
        # The first successor is known by now; only words behind it are searched.
        begin, end, first, want = begin[back], end[back], first[back], base[back] + word + 1
        place = np.where(first == want, begin, -1)
        more = np.flatnonzero((end > begin + 1) & (first < want))
        found = successors.find(want[more])
        place[more] = np.where((found > begin[more]) & (found < end[more]), found, -1)
        return place

    def pairs(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and node of each pair of word ids; node -1 if the pair is not kept."""
        shard, node = pair_shard(first, second, self.model.shards), np.full(len(first), -1, np.int64)
        for s, own in by_shard(shard):
            own = own[may_hold(self._array(f"pairs-{s}", "filter2"), first[own], second[own])]
            new = np.diff(first[own], prepend=-1) != 0  # pairs come in order, mostly
            context = self._list(f"pairs-{s}", "contexts").find(first[own[new]])[np.cumsum(new) - 1]
            own, context = own[context >= 0], context[context >= 0]
            if len(own):
                node[own] = self._children(self._list(f"pairs-{s}", "pointers"), self._list(f"pairs-{s}", "successors"), context, second[own])
        return shard, node

    def of_pairs(self, shard: np.ndarray, node: np.ndarray, name: str) -> np.ndarray:
        out = np.zeros(len(node), np.int64)
        for s, own in by_shard(shard):
            out[own] = self._array(f"pairs-{s}", name)[node[own]]
        return out

    def triples(self, shard: np.ndarray, node: np.ndarray, third: np.ndarray) -> np.ndarray:
        """Stored logarithm of each triple's probability, or -1 if the triple is not kept."""
        out = np.full(len(node), -1, np.int64)
        for s, own in by_shard(shard):
            own = own[may_hold(self._array(f"pairs-{s}", "filter3"), node[own], third[own])]
            own = own[np.argsort(node[own])]
            place = self._children(self._list(f"pairs-{s}", "pointers3"), self._list(f"pairs-{s}", "successors3"), node[own], third[own])
            own, place = own[place >= 0], place[place >= 0]
            out[own] = self._array(f"pairs-{s}", "log3")[place]
        return out

    def log_words(self, ids: np.ndarray) -> np.ndarray:
        """log10 of the add-one probability of each word."""
        distinct, _, back = distinct_of(ids)
        count, known = np.zeros(len(distinct), np.int64), np.flatnonzero(distinct >= 0)
        count[known] = self.of_words(distinct[known], "count")
        return np.log10((count + 1) / (self.model.tokens + self.model.distinct + 1))[back]

    def log_pairs(self, first: np.ndarray, second: np.ndarray, log_second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 P(second | first) with backoff, and shard and node of the pair; ids may be -1."""
        log, shard, node = log_second.copy(), np.zeros(len(first), np.int64), np.full(len(first), -1, np.int64)
        both = np.flatnonzero((first >= 0) & (second >= 0))
        shard[both], node[both] = self.pairs(first[both], second[both])
        kept, less = np.flatnonzero(node >= 0), np.flatnonzero((node < 0) & (first >= 0))
        log[less] -= self.of_words(first[less], "backoff") / STEPS
        log[kept] = -self.of_pairs(shard[kept], node[kept], "log2") / STEPS
        return log, shard, node

    def score(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each token's probability after the words before it in its text, and under the base model."""
        base = self.log_words(ids)
        log = base.copy()
        inside = np.ones(len(ids), bool)
        inside[np.concatenate([[0], ends[:-1]])] = False
        at = np.flatnonzero(inside)
        _, one, back = distinct_of(((ids[at - 1] + 1).astype(U) << U(32)) | (ids[at] + 1).astype(U))
        one = at[one]
        log2, shard, node = self.log_pairs(ids[one - 1], ids[one], base[one])
        log[at] = log2[back]
        shard_at, node_at = np.zeros(len(ids), np.int64), np.full(len(ids), -1, np.int64)
        shard_at[at], node_at[at] = shard[back], node[back]
        third = np.flatnonzero(inside & np.concatenate([[False], inside[:-1]]) & (np.concatenate([[-1], node_at[:-1]]) >= 0))
        if len(third):
            context, of = node_at[third - 1], shard_at[third - 1]
            with_id = np.flatnonzero(ids[third] >= 0)
            code = np.full(len(third), -1, np.int64)
            code[with_id] = self.triples(of[with_id], context[with_id], ids[third[with_id]])
            kept, less = np.flatnonzero(code >= 0), np.flatnonzero(code < 0)
            log[third[kept]] = -code[kept] / STEPS
            log[third[less]] -= self.of_pairs(of[less], context[less], "backoff2") / STEPS
        return log, base


def distinct_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, a place of each, and which of them each value is."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(values)]
    back = np.empty(len(values), np.int64)
    back[order] = np.cumsum(new) - 1
    return ranked[new], order[new], back


@lru_cache(maxsize=2)
def opened(model: Model) -> Reader:
    return Reader(model)


def coded(probability: np.ndarray) -> np.ndarray:
    """One byte for -log10 of a probability."""
    return np.clip(np.rint(-np.log10(np.maximum(probability, 1e-12)) * STEPS), 0, 255).astype(np.uint8)


def encode_texts(df: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held, ids) from (doc_id, held, text): word ids as unsigned 32-bit integers, the largest one for unknown words."""
    schema, ddl = arrow_schema(doc_id="long", held="boolean", ids="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = opened(model)
        for batch in batches:
            number, words, counts = split_words(batch.column(2))
            known = reader.word_ids([*words, END]).astype(np.uint32)
            ends = np.cumsum(counts + 1)
            ids = np.full(int(ends[-1]) if len(ends) else 0, known[-1])
            inside = np.ones(len(ids), bool)
            inside[ends - 1] = False
            ids[inside] = known[number]
            offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column], schema=schema)

    return df.mapInArrow(run, ddl)


def decoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1 for unknown words) of all texts of a column of ``encode_texts``, and where each text ends."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    ids = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.uint32)
    return np.where(ids == 0xFFFFFFFF, -1, ids.astype(np.int64)), (offsets[1:] - offsets[0]) // 4


def _counted_ids(coded_texts: DataFrame, count) -> DataFrame:
    """Rows of BLOCKS from runs of whole coded texts of about RUN_WORDS words."""
    schema, ddl = arrow_schema(shard="int", part="int", keys="binary", more="binary", counts="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, ends = decoded(batch.column(0))
            at = 0
            while at < len(ids):
                to = int(ends[min(np.searchsorted(ends, at + RUN_WORDS - size), len(ends) - 1)])
                held.append(ids[at:to])
                size, at = size + to - at, to
                if size >= RUN_WORDS:
                    yield pa.RecordBatch.from_pydict(count(np.concatenate(held)), schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict(count(np.concatenate(held)), schema=schema)

    return coded_texts.mapInArrow(run, ddl)


def _counted(texts: DataFrame, count) -> DataFrame:
    """Rows of BLOCKS from the counts of each word in runs of whole texts of about RUN_WORDS words."""
    schema, ddl = arrow_schema(shard="int", part="int", keys="binary", more="binary", counts="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        size = 0
        for batch in batches:
            number, words, counts = split_words(batch.column(0))
            times = dict(zip(words, np.bincount(number, minlength=len(words)).tolist()))
            times[END] = len(counts)
            found = {**found, **{w: n + found[w] if w in found else n for w, n in times.items()}} if found else times
            size += len(number) + len(counts)
            if size >= RUN_WORDS:
                yield pa.RecordBatch.from_pydict(count(found), schema=schema)
                found, size = {}, 0
        if size:
            yield pa.RecordBatch.from_pydict(count(found), schema=schema)

    return texts.mapInArrow(run, ddl)


def _each_shard(spark: SparkSession, shards: int, build) -> None:
    """Runs ``build`` for every shard, one task for each of up to 1,024: grouping such short rows would bring all shards into one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"].tolist():
                build(shard)
            yield frame

    spark.range(0, shards, 1, min(shards, 1024)).mapInPandas(run, "id long").agg(F.count(F.lit(1))).collect()


def _per_shard(blocks: DataFrame, build, ddl: str) -> list:
    return blocks.groupBy("shard").applyInPandas(build, ddl).collect()  # one small row for each shard


def train(df: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST) -> tuple[Model, DataFrame]:
    """Count and write the model of the texts that are not held out; gives where it lies, and all texts as word ids.

    Null and empty texts count as texts without words (one end each). An empty table gives a model without words.
    """
    with brief_shuffles(df.sparkSession):
        return _train(df, held_out, id_column, text_column, least)


def _train(df: DataFrame, held_out: Column, id_column: str, text_column: str, least: int) -> tuple[Model, DataFrame]:
    spark = df.sparkSession
    bound_batches(spark)
    named = df.select(F.col(id_column).cast("long").alias("doc_id"), held_out.alias("held"), F.col(text_column).cast("string").alias("text"))
    texts = named.filter("NOT held").select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    folder = local_folder(work_path(spark, "ngram-model"))

    def count_words(found: dict[bytes, int]):
        hashes = np.fromiter(map(word_hash, found), np.int64, len(found))
        counts = np.fromiter(found.values(), np.int64)
        return _send((hashes // shards).astype(U), np.zeros(len(hashes), U), counts, hashes % shards)

    def build_words(rows: pd.DataFrame) -> pd.DataFrame:
        keys, _, counts = _joined(rows)
        shard = int(rows["shard"].iloc[0])
        EliasFano.of(keys).save(f"{folder}/words-{shard}", "hash")
        save(f"{folder}/words-{shard}", "count", narrow(counts))
        save(f"{folder}/words-{shard}", "backoff", np.zeros(len(counts), np.uint8))
        return pd.DataFrame({"shard": [shard], "n": [len(keys)], "tokens": [int(counts.sum())]})

    stats = {r["shard"]: r for r in _per_shard(_counted(texts, count_words), build_words, "shard int, n long, tokens long")}
    for s in set(range(shards)) - set(stats):  # shards without a word
        build_words(pd.DataFrame({"shard": [s], "keys": [b""], "more": [b""], "counts": [b""]}))
    sizes = [stats[s]["n"] if s in stats else 0 for s in range(shards)]
    model = Model(folder, shards, tuple(int(x) for x in np.concatenate([[0], np.cumsum(sizes)[:-1]])), sum(r["tokens"] for r in stats.values()), sum(sizes))
    if model.distinct >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    starts = np.array(model.starts)
    every_text = materialize(encode_texts(named, model), "coded-texts")
    training = every_text.filter("NOT held").select("ids")

    def count_pairs(ids: np.ndarray):
        reader = opened(model)
        end = int(reader.word_ids([END])[0])
        goes = ids[:-1] != end
        if least > 1:
            distinct, back = np.unique(ids, return_inverse=True)
            often = (reader.of_words(distinct, "count") >= least)[back]
            goes &= often[:-1] & often[1:]
        at = np.flatnonzero(goes)
        keys, counts = np.unique((ids[at].astype(U) << U(32)) | ids[at + 1].astype(U), return_counts=True)
        return _send(keys, np.zeros(len(keys), U), counts, pair_shard(keys >> U(32), keys & U(0xFFFFFFFF), shards), ordered=True)

    def build_pairs(rows: pd.DataFrame) -> pd.DataFrame:
        keys, _, counts = _joined(rows)
        kept = counts >= least
        keys, counts = keys[kept], counts[kept]
        shard = int(rows["shard"].iloc[0])
        place = f"{folder}/pairs-{shard}"
        first, second = (keys >> U(32)).astype(np.int64), (keys & U(0xFFFFFFFF)).astype(np.int64)
        contexts, begin = np.unique(first, return_index=True)
        sizes = np.diff(np.append(begin, len(first)))
        EliasFano.of(contexts).save(place, "contexts")
        EliasFano.of(np.append(begin, len(first))).save(place, "pointers")
        EliasFano.of(increasing(second, begin, sizes)).save(place, "successors")
        save(place, "count2", narrow(counts))
        save(place, "filter2", filter_of(first, second))
        # For each context, what it kept: number of successors and their counts, for the vocabulary's shard.
        if not len(keys):
            return pd.DataFrame({"shard": [], "part": [], "keys": [], "more": [], "counts": []})
        kinds, sums = sizes, np.add.reduceat(counts, begin)
        home = np.searchsorted(starts, contexts, "right") - 1
        two = [_send(contexts.astype(U), np.full(len(contexts), k, U), v.astype(np.int64), home) for k, v in ((0, kinds), (1, sums))]
        return pd.DataFrame({k: [*two[0][k], *two[1][k]] for k in two[0]})

    partial = _counted_ids(training, count_pairs).groupBy("shard").applyInPandas(build_pairs, BLOCKS)

    def backoffs(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        keys, kind, values = _joined(rows)
        total = load(f"{folder}/words-{shard}", "count").astype(np.float64)
        kinds, sums = np.zeros(len(total)), np.zeros(len(total))
        at = keys.astype(np.int64) - starts[shard]
        kinds[at[kind == 0]] = values[kind == 0]
        sums[at[kind == 1]] = values[kind == 1]
        save(f"{folder}/words-{shard}", "backoff", coded(np.maximum(1 - (sums - DISCOUNT * kinds) / total, 1e-9)))
        return pd.DataFrame({"shard": [shard]})

    _per_shard(partial, backoffs, "shard int")
    none = pd.DataFrame({"shard": [0], "keys": [b""], "more": [b""], "counts": [b""]})

    def smooth_pairs(shard: int) -> None:
        place = f"{folder}/pairs-{shard}"
        if not os.path.exists(f"{place}/count2.npy"):
            build_pairs(none.assign(shard=shard))
        first, second = pair_words(place)
        counts = load(place, "count2").astype(np.float64)
        reader = Reader(model)
        if len(counts):
            words, _, back = distinct_of(first)
            total, off = reader.of_words(words, "count")[back], reader.of_words(words, "backoff")[back]
            words, _, back = distinct_of(second)
            probability = (counts - DISCOUNT) / total + 10.0 ** (off / -STEPS) * 10.0 ** reader.log_words(words)[back]
        else:
            probability = counts
        save(place, "log2", coded(probability))

    _each_shard(spark, shards, smooth_pairs)

    def count_triples(ids: np.ndarray):
        reader = opened(model)
        end = int(reader.word_ids([END])[0])
        at = np.flatnonzero(ids[:-1] != end)
        key, _, back = distinct_of((ids[at].astype(U) << U(32)) | ids[at + 1].astype(U))
        shard, node = reader.pairs((key >> U(32)).astype(np.int64), (key & U(0xFFFFFFFF)).astype(np.int64))
        code, kept = np.zeros(len(key), np.uint8), np.flatnonzero(node >= 0)
        code[kept] = reader.of_pairs(shard[kept], node[kept], "log2")
        of, nodes, codes = np.zeros(len(ids), np.int64), np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.uint8)
        of[at], nodes[at], codes[at] = shard[back], node[back], code[back]
        # A triple can only be kept if both of its pairs are.
        third = np.flatnonzero((nodes[:-1] >= 0) & (nodes[1:] >= 0)) + 2 if len(ids) > 2 else np.zeros(0, np.int64)
        third = third[third < len(ids)]
        # With a triple goes the stored probability of its last two words, so that its shard need not look them up.
        rows: dict[str, list] = {k: [] for k in ("shard", "part", "keys", "more", "counts")}
        for s, own in by_shard(of[third - 2]):
            own = third[own]
            triple = (nodes[own - 2].astype(U) << U(32)) | ids[own].astype(U)
            order = np.argsort(triple)
            triple = triple[order]
            first = np.flatnonzero(np.concatenate([[True], triple[1:] != triple[:-1]]))
            counts = np.diff(np.append(first, len(triple)))
            for name, value in (("shard", s), ("part", 0), ("keys", pack(triple[first])), ("more", squeeze(codes[own[order[first]] - 1])), ("counts", squeeze(counts))):
                rows[name].append(value)
        return rows

    def build_triples(rows: pd.DataFrame) -> pd.DataFrame:
        keys, code, counts = (np.concatenate([read(x) for x in rows[name]]) for name, read in (("keys", unpack), ("more", widen), ("counts", widen)))
        if len(keys):
            order = np.argsort(keys, kind="stable")  # blocks are in order each
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, code, counts = keys[first], code[order[first]], np.add.reduceat(counts[order].astype(np.int64), first)
            kept = counts >= least
            keys, code, counts = keys[kept], code[kept], counts[kept]
        node, word, counts = (keys >> U(32)).astype(np.int64), (keys & U(0xFFFFFFFF)).astype(np.int64), counts.astype(np.float64)
        shard = int(rows["shard"].iloc[0])
        place = f"{folder}/pairs-{shard}"
        total = load(place, "count2").astype(np.float64)
        kinds = np.bincount(node, minlength=len(total)).astype(np.int64) if len(total) else np.zeros(0, np.int64)
        sums = np.bincount(node, counts, minlength=len(total)) if len(total) else np.zeros(0)
        off = coded(np.maximum(1 - (sums - DISCOUNT * kinds) / total, 1e-9)) if len(total) else np.zeros(0, np.uint8)
        save(place, "filter3", filter_of(node, word))
        begin = np.concatenate([[0], np.cumsum(kinds)])
        EliasFano.of(begin).save(place, "pointers3")
        EliasFano.of(increasing(word, begin[:-1][kinds > 0], kinds[kinds > 0])).save(place, "successors3")
        if len(node):
            power = 10.0 ** (np.arange(256) / -STEPS)
            probability = (counts - DISCOUNT) / total[node] + power[off[node]] * power[code]
        else:
            probability = counts
        save(place, "log3", coded(probability))
        save(place, "backoff2", off)
        return pd.DataFrame({"shard": [shard]})

    _per_shard(_counted_ids(training, count_triples), build_triples, "shard int")

    def fill(shard: int) -> None:
        if not os.path.exists(f"{folder}/pairs-{shard}/backoff2.npy"):
            build_triples(none.assign(shard=shard))

    _each_shard(spark, shards, fill)
    return model, every_text


def increasing(words: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Successor lists, each sorted, as one increasing list: every list continues from the last value of the one before."""
    if not len(words):
        return words
    last = words[begin + sizes - 1] + 1
    base = np.concatenate([[0], np.cumsum(last)[:-1]])
    return words + 1 + np.repeat(base, sizes)


def pair_words(place: str) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a shard, in the order of their nodes."""
    contexts, pointers, successors = (EliasFano.open(place, k) for k in ("contexts", "pointers", "successors"))
    if not successors.n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = pointers.access(np.arange(pointers.n))
    sizes = np.diff(begin)
    values = successors.access(np.arange(successors.n))
    base = np.concatenate([[0], values[begin[1:-1] - 1]])
    return np.repeat(contexts.access(np.arange(contexts.n)), sizes), values - 1 - np.repeat(base, sizes)


def score_texts(df: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``score_coded`` of any texts."""
    named = df.select(F.col(id_column).cast("long").alias("doc_id"), F.lit(False).alias("held"), F.col(text_column).cast("string").alias("text"))
    bound_batches(df.sparkSession)
    return score_coded(encode_texts(named, model), model).drop("held")


def score_coded(coded_texts: DataFrame, model: Model) -> DataFrame:
    """doc_id, held, n_tokens, n_known, base_score, score of each row, a narrow step.

    Null and empty texts have one token, the end. Repeated rows are scored alike; rows without an id keep a null
    id; an empty table gives no rows; further columns are ignored.
    """
    schema, ddl = arrow_schema(doc_id="long", held="boolean", n_tokens="long", n_known="long", base_score="double", score="double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = opened(model)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, ends = decoded(batch.column(2))
            log, base = np.empty(len(ids)), np.empty(len(ids))
            for at in range(0, len(ids), PIECE):
                # Two tokens before the piece are scored again, so that its first ones have their contexts.
                seen, end = max(0, at - 2), min(len(ids), at + PIECE)
                inner = ends[(ends > seen) & (ends < end)] - seen
                some_log, some_base = reader.score(ids[seen:end], np.append(inner, end - seen))
                log[at:end], base[at:end] = some_log[at - seen :], some_base[at - seen :]
            first = np.concatenate([[0], ends[:-1]])
            totals = [np.add.reduceat(x, first) for x in ((ids >= 0).astype(np.int64), base, log)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends, prepend=0)), *map(pa.array, totals)], schema=schema)

    return coded_texts.select("doc_id", "held", "ids").mapInArrow(run, ddl)
