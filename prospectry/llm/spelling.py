"""Spelling variants: words one edit apart, each variant leading to a much more frequent form.

Comparing all pairs of words is not needed. Every word generates its neighbourhood, the strings one edit away, and
asks a Bloom filter whether they may be words:

1. Words are counted: in the task first, then by aggregation.
2. A blocked Bloom filter (one 64-bit block for each word, six bits in it) is built for each length of words, by
   tasks that own some blocks, and broadcast. A filter holds at most ``FILTER_WORDS`` words; a larger vocabulary
   is dealt to several filters, each with its own pass over the words. So a broadcast has at most ``FILTER_WORDS`` * 3 bytes.
3. Each word probes its deletions, and its replacements by a larger letter; the word on the other side of such a
   pair is found by the same edit backwards, so insertions and smaller letters need no probes.
4. Strings that the filter may hold are joined with the vocabulary by equality, which drops the false positives.

Hashes of edited strings come from the word's polynomial hash, without writing the string.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectry.llm.common import arrow_schema, bound_batches, texts_as_bytes
from prospectry.session import materialize

#: Least letters of a word, least occurrences, and how many times more often its form must occur.
LETTERS, OCCURRENCES, TIMES = 7, 2, 10
#: One of so many (document, word) pairs loses a letter before words are counted.
THINNED = 31
#: Words of one filter, bits of a filter for each word, blocks that one task builds, distinct words counted before a task sends, probes made at once.
FILTER_WORDS, WORD_BITS, CHUNK, COUNTED, PROBES = 8_000_000, 24, 4096, 200_000, 1 << 19
RUN = re.compile(f"[a-zÀ-ÿ]{{{LETTERS},}}")
U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def thinned(doc_id: object, word: str) -> str:
    """The word as counted for this document: the rule deletes one letter of some words. A null id is written as nothing."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % THINNED:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of (doc_id, text) with enough letters, from all texts."""
    schema, ddl = arrow_schema(word="string", n="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1))):
                own = Counter(RUN.findall(text.lower().decode("utf-8")))  # bytes are lower-cased in A-Z only
                for word, n in own.items():
                    word = thinned(doc_id, word)
                    if len(word) >= LETTERS:
                        total[word] += n
                if len(total) >= COUNTED:
                    yield sent()
                    total.clear()
        yield sent()

    return docs.mapInArrow(run, ddl).groupBy("word").agg(F.sum("n").alias("n"))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def patterns() -> np.ndarray:
    """65,536 patterns of up to six bits."""
    bits = mix(np.arange(1 << 16, dtype=U) + U(1))
    out = np.zeros(1 << 16, U)
    for k in range(6):
        out |= U(1) << ((bits >> U(6 * k)) & U(63))
    return out


def powers(size: int) -> np.ndarray:
    out = np.full(size, U(BASE))
    out[:1] = 1
    return np.cumprod(out, dtype=U)


def letters_of(words: list[str]) -> np.ndarray:
    """Letters of words of one length, a row each; every letter is at most U+00FF."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places of the words with that length)."""
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes).tolist():
        yield size, np.flatnonzero(sizes == size)


class Filters:
    """Where the blocks of each length lie, and the blocks themselves."""

    def __init__(self, words_of_length: dict[int, int]) -> None:
        self.start, self.blocks_of, at = {}, {}, 0
        for size, n in sorted(words_of_length.items()):
            self.start[size], self.blocks_of[size] = at, max(1, -(-n * WORD_BITS // 64))
            at += self.blocks_of[size]
        self.total = at
        self.blocks = np.zeros(0, U)

    def place(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block and number of the pattern of strings with these polynomial hashes."""
        x = mix(hashes)
        return self.start[size] + ((x >> U(16)) % U(self.blocks_of[size])).astype(np.int64), (x & U(0xFFFF)).astype(np.int64)


def build_filters(words: DataFrame, filters: Filters) -> np.ndarray:
    """The blocks of all ``words``; a task builds CHUNK blocks."""
    schema, ddl = arrow_schema(chunk="int", block="long", bits="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = patterns()
        for batch in batches:
            some = batch.column(0).to_pylist()
            for size, at in by_length(some):
                letters = letters_of([some[i] for i in at.tolist()])
                block, number = filters.place(size, ((letters.astype(U) + U(1)) * powers(size)).sum(1, dtype=U))
                yield pa.RecordBatch.from_arrays([pa.array(block // CHUNK, pa.int32()), pa.array(block), pa.array(table[number].view(np.int64))], schema=schema)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        chunk = int(rows["chunk"].iloc[0])
        out = np.zeros(min(CHUNK, filters.total - chunk * CHUNK), U)
        np.bitwise_or.at(out, rows["block"].to_numpy() - chunk * CHUNK, rows["bits"].to_numpy().view(U))
        return pd.DataFrame({"chunk": [chunk], "blocks": [out.tobytes()]})

    blocks = np.zeros(filters.total, U)
    merged = words.select("word").mapInArrow(run, ddl).groupBy("chunk", "block").agg(F.bit_or("bits").alias("bits"))
    for chunk, data in merged.groupBy("chunk").applyInPandas(build, "chunk int, blocks binary").collect():  # the filter, of bounded size
        blocks[chunk * CHUNK : chunk * CHUNK + len(data) // 8] = np.frombuffer(data, U)
    return blocks


def probe(letters: np.ndarray, alphabet: np.ndarray, filters: Filters, table: np.ndarray) -> Iterator[tuple[int, str]]:
    """(row, string) of the edits that the filter may hold: deletions, and replacements by a larger letter."""
    n, size = letters.shape
    codes, power = letters.astype(U) + U(1), powers(size)
    sums = np.zeros((n, size + 1), U)
    np.cumsum(codes * power, axis=1, out=sums[:, 1:], dtype=U)

    def hits(length: int, hashes: np.ndarray) -> np.ndarray:
        block, number = filters.place(length, hashes)
        bits = table[number]
        return np.flatnonzero(filters.blocks[block] & bits == bits)

    if size - 1 in filters.start:
        # Deleting any of several equal letters in a row gives one string: the last of them stands for all.
        row, at = np.nonzero(np.concatenate([letters[:, 1:] != letters[:, :-1], np.ones((n, 1), bool)], 1))
        for a in range(0, len(row), PROBES):
            r, i = row[a : a + PROBES], at[a : a + PROBES]
            for k in hits(size - 1, sums[r, i] + (sums[r, size] - sums[r, i + 1]) * U(INVERSE)).tolist():
                word = letters[r[k]].tobytes().decode("latin-1")
                yield int(r[k]), word[: i[k]] + word[i[k] + 1 :]
    if size in filters.start:
        width = max(1, PROBES // (n * len(alphabet)))
        for a in range(0, size, width):
            here = letters[:, a : a + width]
            row, at, to = np.nonzero(alphabet[None, None, :] > here[:, :, None])
            at += a
            step = (alphabet[to].astype(U) - letters[row, at].astype(U)) * power[at]
            for k in hits(size, sums[row, size] + step).tolist():
                word = letters[row[k]].tobytes().decode("latin-1")
                yield int(row[k]), f"{word[: at[k]]}{chr(alphabet[to[k]])}{word[at[k] + 1 :]}"


def candidates(words: DataFrame, alphabet: np.ndarray, filters: Filters) -> DataFrame:
    """(word, n, other): strings one edit away that the filters may hold."""
    shared = words.sparkSession.sparkContext.broadcast(filters)  # at most FILTER_WORDS * WORD_BITS / 8 bytes of blocks
    schema, ddl = arrow_schema(word="string", n="long", other="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, table = shared.value, patterns()
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for size, at in by_length(words):
                rows = max(1, PROBES // (size * len(alphabet)))
                for a in range(0, len(at), rows):
                    own = at[a : a + rows].tolist()
                    found = list(probe(letters_of([words[i] for i in own]), alphabet, held, table))
                    places = [own[r] for r, _ in found]
                    columns = [words[i] for i in places], [counts[i] for i in places], [s for _, s in found]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    found = materialize(words.select("word", "n").mapInArrow(run, ddl), "near-candidates")
    shared.destroy()
    return found


def near_words(words: DataFrame, filter_words: int = FILTER_WORDS) -> DataFrame:
    """(word, n, near, near_n) of all pairs one edit apart, in both directions, among distinct (word, n)."""
    spark = words.sparkSession
    alphabet = sorted(ord(r[0]) for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct().collect())  # letters
    if not alphabet:
        return spark.createDataFrame([], "word string, n long, near string, near_n long")
    parts = max(1, -(-words.count() // filter_words))
    found = None
    for p in range(parts):
        own = words.filter(F.pmod(F.xxhash64("word"), F.lit(parts)) == p)
        sizes = {r[0]: r[1] for r in own.groupBy(F.length("word")).count().collect()}  # one row for each length of words
        filters = Filters(sizes)
        if sizes:
            filters.blocks = build_filters(own, filters)
            some = candidates(words, np.array(alphabet, np.uint8), filters)
            found = some if found is None else found.unionByName(some)
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = found.withColumnRenamed("other", "near").join(known, "near").select("word", "n", "near", "near_n")
    back = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.unionByName(back)


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) by following (word, form) to the end; each round doubles the steps.

    A form occurs at least ``TIMES`` as often, so a chain has at most 19 steps, which five rounds reach.
    """
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range(5):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        roots = materialize(roots.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "spelling-roots")
    return roots


def variants(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", filter_words: int = FILTER_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word with at least LETTERS letters and OCCURRENCES occurrences.

    A word's form is the most frequent word one edit away (of equally frequent ones the first in code-point order),
    if it occurs at least TIMES as often; the root is where forms lead in the end, or the word itself. Words are
    whole runs of letters of whole texts, however long. Null and empty texts have none; a null id counts as an
    empty one; repeated rows count each time; an empty table gives no rows; further columns are ignored.
    """
    bound_batches(df.sparkSession)
    docs = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    words = materialize(count_words(docs).filter(F.col("n") >= OCCURRENCES), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), "near"))
    judged = near_words(words, filter_words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    accepted = -F.col("best.rank") >= TIMES * F.col("n")
    judged = materialize(
        judged.select("word", "n_near", F.when(accepted, F.col("best.near")).alias("form"), F.when(accepted, -F.col("best.rank")).alias("form_n")), "spelling-forms"
    )
    roots = last_forms(judged.filter("form IS NOT NULL").select("word", "form"))
    return words.join(judged, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )
