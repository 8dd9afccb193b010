"""Benchmark decontamination by latent semantic retrieval.

1. Vocabulary: the words of the benchmark and the most frequent words of all documents, with the document frequencies
   of the whole corpus. Texts are then written as numbers of these terms, once for all further steps.
2. A randomised SVD of the TF-IDF matrix of the passages of all documents and the benchmark's passages: tasks multiply
   their sparse rows, partial products are summed by blocks of terms, and only (terms x rank) matrices, whose
   size is fixed by parameters, reach the driver.
3. Every passage of every document is projected, and the cosine with each benchmark passage gives candidates.
4. Around each candidate, the longest common subsequence of words decides; pairs in a middle range count as
   paraphrases only if the item's answer, its last words, is found too.

The benchmark is the stated query set: it is held by the driver and sent to the tasks, which compare passages with
``BLOCK`` of its passages at a time. Passages are windows of ``WINDOW`` words that overlap by half and cover whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectry.llm.common import arrow_schema, bound_batches, forget, free_name, row_key, texts_as_bytes
from prospectry.session import materialize

WINDOW, BLOCK = 32, 256
#: Words of the vocabulary besides the benchmark's, and counts of words and bytes of text that a counting task gathers before it sends.
MORE_WORDS, RUN_WORDS, RUN_BYTES = 8192, 1 << 20, 32 << 20
RANK, OVERSAMPLE, POWER = 192, 16, 2
#: Weight of all benchmark passages in the decomposition, against all of the sample's.
OWN_WEIGHT = 1.5
#: Least cosine of a candidate; least share of an item's words in sequence; the same if the answer is found.
COSINE, SAME, PARAPHRASE, ANSWER = 0.35, 0.75, 0.5, 0.6
DROP = b".,;:!?\"'()[]{}*|"
TERMS_A_BLOCK = 1024
MATCHES = {"doc_id": "long", "item_id": "long", "cosine": "double", "lcs": "double", "answer": "double", "at_word": "long"}
#: Passages for each task of the decomposition at least, beyond one task a core, since each sends a whole (terms x rank) matrix.
TASK_ROWS = 250_000
#: Passages that are multiplied at a time, and occurrences from which a term among them counts as frequent.
ROWS, OFTEN = 2048, 64
#: Bytes of texts whose words are hashed, and counted, at a time.
CHUNK, GROUP = 1 << 18, 1 << 20
LOWER = bytes(range(256)).lower()
SPACE = bytes(not bytes([b]).split() for b in range(256))
#: A word's hash is its length times LENGTH and the sum of its bytes, each times BASE to the power of its place.
BASE, LENGTH = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(None, DROP).split()


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64."""
    both = [np.full(size, x, np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64))]
    for x in both:
        x[0] = 1
    return np.cumprod(both[0]), np.cumprod(both[1])


def _hashed(clean: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, begin and end of each word of ``clean``, which begins and ends with white space."""
    raw = np.frombuffer(clean, np.uint8)
    power, inverse = _powers(max(2 * CHUNK, 1 << len(raw).bit_length()))
    space = np.frombuffer(clean.translate(SPACE), bool)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    sums = np.cumsum(raw * power[: len(raw)])
    return (sums[end - 1] - sums[begin - 1]) * inverse[begin] + (end - begin).astype(np.uint64) * np.uint64(LENGTH), begin, end


def hashes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, number of words of each text, and the cleaned texts with the begin and end of each word.

    The words are those of ``words_of``. Long input is cut between words, so that what is computed for its bytes stays small.
    """
    clean = [t.translate(LOWER, DROP) for t in texts]
    first = np.cumsum([1, *(len(t) + 1 for t in clean)])
    joined = b" ".join([b"", *clean, b""])
    parts, at = [], 0
    while at < len(joined) - 1:
        # A piece ends with the first white space from CHUNK bytes on, with which the next one begins.
        upto = at + CHUNK
        while upto < len(joined) and not SPACE[joined[upto]]:
            upto += 1
        piece = _hashed(joined[at : upto + 1])
        parts.append((piece[0], piece[1] + at, piece[2] + at))
        at = upto
    hashes, begin, end = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, k) for k in (np.uint64, np.int64, np.int64))
    return hashes, np.diff(np.searchsorted(begin, first)), joined, begin, end


def _groups(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Whole texts, about GROUP bytes at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= GROUP:
            yield held
            held, size = [], 0
    if held:
        yield held


def _distinct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Hashes of the different words of texts, in order, the number of texts that hold each, and the words."""
    hashes, sizes, joined, begin, end = hashes_of(texts)
    order = np.argsort(hashes)
    new = np.concatenate([[True], np.diff(hashes[order]) != 0])[: len(order)]
    one = order[new]
    # A word that repeats in its text counts once.
    of = np.repeat(np.arange(len(texts)), sizes)
    pairs = np.sort((np.cumsum(new) - 1) * len(texts) + of[order])
    pairs = pairs[np.concatenate([[True], np.diff(pairs) != 0])[: len(pairs)]]
    size = end[one] - begin[one]
    ends = np.cumsum(np.append(0, size))
    letters = np.frombuffer(joined, np.uint8)[np.repeat(begin[one] - ends[:-1], size) + np.arange(ends[-1])]
    words = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters)])
    return hashes[one], np.bincount(pairs // max(1, len(texts)), minlength=len(one)), words


class Numbers:
    """Numbers of terms by the hash of the word, as a table of buckets by the hash's first bits."""

    BITS = 16

    def __init__(self, terms: dict[bytes, int]) -> None:
        hashes = self.mixed(hashes_of([b" ".join(terms)])[0])
        order = np.argsort(hashes)
        self.none = len(terms)
        self.begin = np.searchsorted(hashes[order] >> np.uint64(64 - self.BITS), np.arange(1 << self.BITS)).astype(np.int32)
        self.most = int(np.diff(self.begin, append=len(order)).max())
        self.hashes = np.append(hashes[order], np.zeros(self.most + 1, np.uint64))
        self.numbers = np.append(np.fromiter(terms.values(), np.int64, len(terms))[order], np.full(self.most + 1, self.none)).astype(kind_of(self.none))

    @staticmethod
    def mixed(hashes: np.ndarray) -> np.ndarray:
        return (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, ``none`` for other words."""
        wanted = self.mixed(hashes)
        place = self.begin[wanted >> np.uint64(64 - self.BITS)]
        out = np.full(len(hashes), self.none, self.numbers.dtype)
        for _ in range(self.most):
            np.copyto(out, self.numbers[place], where=self.hashes[place] == wanted)
            place += 1
        return out


def common(item: dict, size: int, words: list) -> int:
    """Length of the longest common subsequence; ``item`` gives each of its words the bits of its places."""
    full = row = (1 << size) - 1
    for word in words:
        places = item.get(word)
        if places:
            match = row & places
            row = ((row + match) | (row - match)) & full
    return size - row.bit_count()


def places(words: list) -> dict:
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def answer_of(words: list) -> list:
    """An item's last quarter, at least three words."""
    return words[-max(3, len(words) // 4) :]


@dataclass
class Space:
    """What a search task needs: projection of terms, and the projected benchmark passages."""

    project: np.ndarray  # (terms + 1) x rank, times IDF; the last row, for other words, is zero
    energy: np.ndarray  # squared IDF of terms; other words count as a term of mean IDF
    items: list[tuple[int, list[int]]]  # words as numbers of terms
    passages: np.ndarray  # passages x rank, unit length
    owner: np.ndarray  # item of each passage


def vocabulary(texts: DataFrame, items: list[list[bytes]]) -> tuple[dict[bytes, int], np.ndarray]:
    """Place of each term, and its IDF over all texts; terms are the items' words and the MORE_WORDS most frequent ones."""
    spark = texts.sparkSession
    schema, ddl = arrow_schema(word="binary", n="long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        def send() -> pa.RecordBatch:
            hashes, times = np.concatenate([np.zeros(0, np.uint64), *seen[0]]), np.concatenate([np.zeros(0, np.int64), *seen[1]])
            order = np.argsort(hashes)
            first = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order[:1]]))
            n = np.add.reduceat(times[order], first) if len(first) else times
            words = pa.concat_arrays([pa.array([], pa.binary()), *seen[2]]).take(pa.array(order[first]))
            return pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([None], pa.binary())]), pa.array(np.append(n, rows))], schema=schema)

        seen: tuple[list, list, list] = ([], [], [])
        rows = held = 0
        for batch in batches:
            for texts in _groups(texts_as_bytes(batch.column(0))):
                for all_of, own in zip(seen, _distinct(texts)):
                    all_of.append(own)
                rows += len(texts)
                held += sum(map(len, texts))
                # Long texts are what fills memory with few words.
                if sum(map(len, seen[0])) >= RUN_WORDS or held >= RUN_BYTES:
                    yield send()
                    seen, rows, held = ([], [], []), 0, 0
        yield send()

    # The row without a word has the number of texts.
    counts = materialize(texts.mapInArrow(count, ddl).groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    total = (counts.filter("word IS NULL").first() or (None, 0))[1]
    top = counts.filter("word IS NOT NULL").orderBy(F.desc("n"), "word").limit(MORE_WORDS).collect()
    own = list(dict.fromkeys(w for words in items for w in words))
    mine = counts.join(spark.createDataFrame([(w,) for w in own], "word binary"), "word").collect()
    df = {bytes(r["word"]): r["n"] for r in [*top, *mine]}
    terms = {w: k for k, w in enumerate(dict.fromkeys([*own, *(bytes(r["word"]) for r in top)]))}
    return terms, np.log((1 + total) / (1 + np.array([df.get(w, 0) for w in terms], np.int64))) + 1e-3


def encode(named: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(id, ids) from (id, text): the words of each text as numbers of terms; ``len(terms)`` stands for other words."""
    shared = named.sparkSession.sparkContext.broadcast(Numbers(terms))
    schema, ddl = arrow_schema(id="long", ids="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        for batch in batches:
            out = []
            for texts in _groups(texts_as_bytes(batch.column(1))):
                hashes, sizes = hashes_of(texts)[:2]
                ids, end = numbers.of(hashes), np.cumsum(sizes).tolist()
                out += [ids[a:b].tobytes() for a, b in zip([0, *end], end)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], schema=schema)

    coded = materialize(named.mapInArrow(run, ddl), "coded-texts")
    shared.destroy()
    return coded


def kind_of(terms: int) -> np.dtype:
    return np.dtype(np.uint16 if terms < 1 << 16 else np.uint32)


def decoded(column: pa.Array, terms: int) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), kind_of(terms)) for x in column]


def _summed(parts: DataFrame, kind, size: int) -> np.ndarray:
    """Sum of arrays given in blocks, added up on the cluster in two steps; the driver gets one array."""
    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(rows["counts"].iloc[0]) // np.dtype(kind).itemsize)
        for x in rows["counts"]:
            total += np.frombuffer(x, kind)
        total = total.astype(kind)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "part": [0], "counts": [total.tobytes()]})

    spread = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16)))
    some = spread.groupBy("block", "part").applyInPandas(add, "block int, part int, counts binary")
    rows = some.groupBy("block").applyInPandas(add, "block int, part int, counts binary").collect()
    out = [np.frombuffer(r["counts"], kind) for r in sorted(rows, key=lambda r: r["block"])]
    return np.concatenate(out) if out else np.zeros(size, kind)


def passages_of(texts: list[np.ndarray], none: int) -> np.ndarray:
    """Passages of texts, a row each, filled up with ``none``."""
    sizes = [-(-len(t) // WINDOW) for t in texts]
    out = np.full((sum(sizes), WINDOW), none, kind_of(none))
    flat, at = out.reshape(-1), 0
    for t, n in zip(texts, sizes):
        flat[at : at + len(t)] = t
        at += n * WINDOW
    return out


def sums_of(table: np.ndarray, rows: np.ndarray, upto: list[int] | None = None) -> np.ndarray:
    """For each row of places, the sum of these rows of ``table``; ``upto``: column k counts in so many rows, for the others it adds zero."""
    out = table[rows[:, 0]]
    more = np.empty_like(out)
    for k in range(1, rows.shape[1]):
        size = len(rows) if upto is None else upto[k]
        np.take(table, rows[:size, k], axis=0, out=more[:size], mode="clip")
        out[:size] += more[:size]
    return out


def _lengths(rows: np.ndarray, energy: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Rows of terms in order, those with the most terms first, the squared length of their TF-IDF rows, and how many rows have more than k terms."""
    some = np.sort(rows, axis=1)
    size = np.count_nonzero(some != len(energy) - 1, axis=1)
    some = some[np.argsort(-size, kind="stable")]
    upto = (len(some) - np.cumsum(np.bincount(size, minlength=some.shape[1] + 1))).tolist()
    new = np.ones(some.shape, bool)
    new[:, 1:] = some[:, 1:] != some[:, :-1]
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, some.size)).astype(np.float64)
    return some, np.bincount(first // some.shape[1], times * times * energy[some.reshape(-1)[first]], len(some)), upto


def _inner_products(rows: np.ndarray, basis: np.ndarray, energy: np.ndarray) -> np.ndarray:
    """(C basis)'(C basis) for the rows of terms, C as in ``_add_products``."""
    out = np.zeros((basis.shape[1], basis.shape[1]))
    for at in range(0, len(rows), ROWS):
        some, length, upto = _lengths(rows[at : at + ROWS], energy)
        y = sums_of(basis, some, upto) * np.sqrt(np.divide(1, length, out=np.zeros(len(some)), where=length > 0)).astype(np.float32)[:, None]
        out += y.T @ y
    return out


def _add_products(rows: np.ndarray, basis: np.ndarray, energy: np.ndarray, total: np.ndarray) -> None:
    """Adds C'C basis to ``total`` for the rows of terms, C being counts divided by the length of the TF-IDF row.

    ``basis`` and ``energy`` (squared IDF) are zero for other words. Terms that occur OFTEN among the rows are multiplied as a
    matrix of counts, the others summed together, the most frequent ones first.
    """
    none = len(energy) - 1
    for at in range(0, len(rows), ROWS):
        some, length, upto = _lengths(rows[at : at + ROWS], energy)
        width = some.shape[1]
        y = sums_of(basis, some, upto) * np.divide(1, length, out=np.zeros(len(some)), where=length > 0).astype(np.float32)[:, None]
        flat = some.reshape(-1)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        inside = int(np.searchsorted(flat, none))
        flat, row = flat[:inside], order[:inside] // width
        first = np.flatnonzero(np.diff(flat.astype(np.int64), prepend=-1))
        often = np.diff(np.append(first, inside))
        many = often >= OFTEN
        terms = flat[first[many]]
        if len(terms):
            term = np.repeat(np.arange(len(terms)), often[many])
            counts = np.bincount(term * len(some) + row[np.repeat(many, often)], minlength=len(terms) * len(some))
            total[terms] += counts.reshape(len(terms), len(some)).astype(np.float32) @ y
        rest = np.flatnonzero(~many)
        rest = rest[np.argsort(-often[rest], kind="stable")]
        for x in range(0, len(rest), ROWS):
            own = rest[x : x + ROWS]
            places, part = first[own], y[row[first[own]]]
            more = np.empty_like(part)
            for k in range(1, int(often[own[0]])):
                upto = int(np.searchsorted(-often[own], -k))  # terms that occur more than k times
                np.take(y, row[places[:upto] + k], axis=0, out=more[:upto], mode="clip")
                part[:upto] += more[:upto]
            total[flat[places]] += part


def _right_vectors(coded: DataFrame, idf: np.ndarray, own: list[np.ndarray], rank: int, seed: int) -> np.ndarray:
    """Right singular vectors (terms x rank) of the documents' and the benchmark's TF-IDF rows."""
    n = len(idf)
    width = min(n, rank + OVERSAMPLE)
    spark = coded.sparkSession
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0].astype(np.float32)
    schema, ddl = arrow_schema(block="int", counts="binary")
    energy = np.append(idf**2, 0)
    by_size: dict[int, list[np.ndarray]] = {}
    for w in own:
        by_size.setdefault(len(w), []).append(w)

    def weighted(basis: np.ndarray) -> np.ndarray:
        """Rows of the basis times IDF, and a zero row for other words."""
        return np.concatenate([basis * idf[:, None], np.zeros((1, width))]).astype(np.float32)

    passages = F.ceil(F.octet_length("ids") / (kind_of(n).itemsize * WINDOW))
    rows = coded.agg(F.sum(passages)).first()[0] or 0
    own_weight = OWN_WEIGHT * max(1, rows) / max(1, len(own))
    few = coded.select("ids").coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))
    for _ in range(POWER):
        basis = weighted(q)
        shared = spark.sparkContext.broadcast(basis)

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n + 1, width), np.float32)
            for batch in batches:
                _add_products(passages_of(decoded(batch.column(0), n), n), shared.value, energy, total)
            total = (total[:n] * idf[:, None]).astype(np.float32)
            blocks = [total[at : at + TERMS_A_BLOCK].tobytes() for at in range(0, n, TERMS_A_BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], schema=schema)

        mine = np.zeros((n + 1, width), np.float32)
        for windows in by_size.values():
            _add_products(np.stack(windows), basis, energy, mine)
        w = _summed(few.mapInArrow(multiply, ddl), np.float32, n * width).reshape(n, width) + own_weight * mine[:n] * idf[:, None]
        shared.destroy()
        q = np.linalg.qr(w)[0].astype(np.float32)

    # The matrix within the span of q: products of the projected rows with each other are all that is needed.
    basis = weighted(q)
    shared = spark.sparkContext.broadcast(basis)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            total += _inner_products(passages_of(decoded(batch.column(0), n), n), shared.value, energy)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=schema)

    small = _summed(few.mapInArrow(project, ddl), np.float64, width * width).reshape(width, width)
    small = small + own_weight * sum(_inner_products(np.stack(windows), basis, energy) for windows in by_size.values())
    shared.destroy()
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return q @ vectors[:, np.argsort(-values)[:rank]].astype(np.float32)


def _item_windows(words: list[int]) -> list[list[int]]:
    """An item as a whole, and the windows of one that is much longer than a passage."""
    if len(words) <= WINDOW * 3 // 2:
        return [words]
    return [words, *[words[at : at + WINDOW] for at in range(0, len(words) - WINDOW // 2, WINDOW // 2)]]


def fit(named: DataFrame, items: list[tuple[int, bytes]], rank: int = RANK, seed: int = 11) -> tuple[Space, DataFrame]:
    """Latent space of the benchmark items and all documents (id, text), and the documents as numbers of its terms."""
    split = [(i, words_of(t)) for i, t in items]
    terms, idf = vocabulary(named.select("text"), [words for _, words in split])
    coded = encode(named, terms)
    numbers = [(i, [terms[w] for w in words]) for i, words in split]
    windows = [(k, w) for k, (_, words) in enumerate(numbers) for w in _item_windows(words) if w]
    own = [np.array(w, kind_of(len(terms))) for _, w in windows]
    vectors = _right_vectors(coded, idf, own, rank, seed)
    project = np.concatenate([vectors * idf[:, None], np.zeros((1, vectors.shape[1]))]).astype(np.float32)
    inside = np.array([project[x].sum(0) for x in own]).reshape(len(own), -1)
    inside /= np.maximum(np.linalg.norm(inside, axis=1, keepdims=True), 1e-9)
    energy = np.append(idf**2, np.mean(idf) ** 2).astype(np.float32)
    return Space(project, energy, numbers, inside.astype(np.float32), np.array([k for k, _ in windows], np.int64)), coded


def candidates(space: Space, docs: list[np.ndarray], cosine: float) -> Iterator[tuple[int, int, int, float]]:
    """(document, first word, item, cosine) of the passages near a benchmark passage.

    The cosine is that of the passage itself, the part of it outside the latent space included, and the
    projected benchmark passage: what two passages share only in the space's main directions stays small.
    """
    half = WINDOW // 2
    none = len(space.energy) - 1
    for at, upto in _slices(docs):
        some = docs[at:upto]
        sizes = np.array([max(2, -(-len(d) // half)) for d in some])  # in half windows; short texts count as one window
        first = np.concatenate([[0], np.cumsum(sizes)])
        ids, energy = np.full(first[-1] * half, none, np.int64), np.zeros(first[-1] * half, np.float32)
        for k, d in enumerate(some):
            here = slice(first[k] * half, first[k] * half + len(d))
            ids[here] = d
            energy[here] = space.energy[ids[here]]
        rows = ids.reshape(-1, half)
        halves = np.concatenate([sums_of(space.project, rows[x : x + 512]) for x in range(0, len(rows), 512)])
        near = halves[:-1] + halves[1:]
        energy = energy.reshape(-1, half).sum(1)
        length = np.sqrt(energy[:-1] + energy[1:])
        real = np.ones(len(near), bool)
        real[first[1:-1] - 1] = False  # not across documents
        where = np.flatnonzero(real & (length > 0))
        for x in range(0, len(where), 2048):
            part = where[x : x + 2048]
            query = near[part] / length[part, None]
            for y in range(0, len(space.passages), BLOCK):
                score = query @ space.passages[y : y + BLOCK].T
                r, c = np.divmod(np.flatnonzero(score >= cosine), score.shape[1])
                doc = np.searchsorted(first, part[r], "right") - 1
                yield from zip((doc + at).tolist(), ((part[r] - first[doc]) * half).tolist(), space.owner[y + c].tolist(), score[r, c].tolist())


def _slices(docs: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for k, d in enumerate(docs):
        size += len(d) + WINDOW
        if size > 50_000 or k + 1 == len(docs):
            yield at, k + 1
            at, size = k + 1, 0


def _portions(batches: Iterator[pa.RecordBatch], size: int = 1 << 18) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and whole coded texts, about ``size`` bytes at a time: what is computed for them takes many times that memory."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1))):
            ids.append(i)
            texts.append(t)
            held += len(t)
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts


def _match(coded: DataFrame, space: Space, cosine: float) -> DataFrame:
    shared = coded.sparkSession.sparkContext.broadcast(space)
    schema, ddl = arrow_schema(**MATCHES)
    kind = kind_of(len(space.energy) - 1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        space = shared.value
        ready = {k: (i, words, places(words), frozenset(words), Counter(words), answer_of(words)) for k, (i, words) in enumerate(space.items)}
        for ids, held in _portions(batches):
            texts = [np.frombuffer(t, kind) for t in held]
            best: dict[tuple[int, int], tuple] = {}
            done: set[tuple[int, int, int]] = set()
            for doc, first, k, score in candidates(space, texts, cosine):
                item_id, words, bits, distinct, times, answer = ready[k]
                reach = len(words)
                if (doc, k, first // reach) in done:
                    continue
                done.add((doc, k, first // reach))
                # Around all windows of this stretch, wide enough to hold the item wherever it lies.
                start = max(0, first // reach * reach - reach)
                near = texts[doc][start : first // reach * reach + 2 * reach + WINDOW].tolist()
                # As many of the item's words as occur nearby is the most that the sequences can share.
                if sum(map(times.__getitem__, distinct.intersection(near))) < PARAPHRASE * len(words):
                    continue
                share = _best_share(bits, len(words), near)
                if share < PARAPHRASE:
                    continue
                found = common(places(answer), len(answer), near) / len(answer)
                if share >= SAME or found >= ANSWER:
                    row = (score, share, found, start)
                    if row[1:3] + row[:1] > (best[doc, k][1:3] + best[doc, k][:1] if (doc, k) in best else ()):
                        best[doc, k] = row
            rows = [(ids[d], ready[k][0], *row) for (d, k), row in sorted(best.items())]
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return coded.mapInArrow(search, ddl)


def _best_share(bits: dict, size: int, words: list) -> float:
    """Greatest share of the item found in sequence within a stretch of one and a half times its length."""
    span = size + size // 2 + 2
    step = max(1, size // 4)
    top = 0
    for at in range(0, max(1, len(words) - span + step), step):
        top = max(top, common(bits, size, words[at : at + span]))
    return top / size


def matches(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    item_text: str = "text", cosine: float = COSINE, rank: int = RANK,
) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, at_word): one row for each document and benchmark item found in it.

    lcs and answer are shares of the item's and the answer's words. Texts that repeat give a row each; items
    that repeat too. Null and empty texts match nothing, nor do items without words or without an id; documents without an id
    give rows with a null id. Further columns are ignored. An empty corpus or benchmark gives no rows.
    """
    bound_batches(docs.sparkSession)
    rows = benchmark.select(F.col(item_column).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").collect()
    items = sorted((r["i"], r["t"].encode("utf-8")) for r in rows)
    items = [x for x in items if words_of(x[1])]
    if not items:
        return docs.sparkSession.createDataFrame([], arrow_schema(**MATCHES)[1])
    space, coded = fit(docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")), items, rank)
    return _match(coded, space, cosine)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those in which a benchmark item was found; rows without an id stay."""
    key = free_name(docs, "_key")
    # A row goes by the hash of its id and text, so another text under the same id is judged by itself.
    marked = docs.withColumn(key, row_key(id_column, text_column))
    found = matches(marked, benchmark, key, text_column).select(F.col("doc_id").alias("_found")).filter("_found IS NOT NULL").distinct()
    found = materialize(found, "contaminated")
    return marked.join(found, marked[key] == found["_found"], "left_anti").drop(key)
