"""BPE encoding and decoding with a public vocabulary.

Encoding keeps a word's symbols in a doubly linked list and its possible merges in a priority queue of
(rank, place). The best merge is taken until none is left; queue entries whose symbols have changed since
are stale and skipped. Decoding puts the vocabulary strings of the ids one after another, parted by a
space, which is what a tokenizer file without a decoder asks for.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prospectry.llm.common import arrow_schema, bound_batches, kept

#: Words remembered by a worker, in each of two generations; only speed depends on it.
REMEMBERED = 120_000
#: Bytes of ids and decoded text that go out in one batch, or one row if that is longer.
PIECE = 2 << 20
#: Low bits of a queue entry: a place in a word.
PLACE = (1 << 40) - 1
#: Letters from here on are split by the tokenizers library's own Unicode tables.
BEYOND = "\u0250"
FAR = re.compile(f"[{BEYOND}-\U0010ffff]")
WHITE = regex.compile(r"\s+")
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(plain)))
    return [letters[b] for b in range(256)]


class WordBpe:
    """A tokenizer file of the kind: NFC, white space dropped, lower case, byte letters, word-end suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.strings = [strings.get(i, "") for i in range(max(strings, default=-1) + 1)]
        self.pairs = [self.vocab[left] << 20 | self.vocab[right] for left, right in model["merges"]]
        self.merged = [self.vocab[left + right] for left, right in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(self.pairs)}
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # The library only normalises and splits here, so it gets no vocabulary to hold.
        library = Tokenizer.from_str(json.dumps({**spec, "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.letters = {ord(b): x for b, x in zip(map(chr, range(256)), byte_letters())}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.new_words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def word_ids(self, letters: str) -> list[int]:
        """Ids of one word in byte letters, by merging the best-ranked pair until no pair has a rank.

        A queue entry is one integer, rank before place. Each rank belongs to one pair, so an entry is stale
        exactly if the two symbols at its place are not that pair any more.
        """
        vocab, ranks, pairs, merged = self.vocab, self.ranks, self.pairs, self.merged
        symbols = [vocab[x] for x in letters[:-1]]
        symbols.append(vocab[letters[-1] + self.suffix])
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            rank = ranks.get(symbols[i] << 20 | symbols[i + 1])
            if rank is not None:
                queue.append(rank << 40 | i)
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            rank, at = entry >> 40, entry & PLACE
            to = after[at]
            if to < 0 or pairs[rank] != symbols[at] << 20 | symbols[to]:
                continue  # stale
            now = symbols[at] = merged[rank]
            symbols[to] = -1
            right = after[at] = after[to]
            if right >= 0:
                before[right] = at
                rank = ranks.get(now << 20 | symbols[right])
                if rank is not None:
                    heapq.heappush(queue, rank << 40 | at)
            left = before[at]
            if left >= 0:
                rank = ranks.get(symbols[left] << 20 | now)
                if rank is not None:
                    heapq.heappush(queue, rank << 40 | left)
        return [s for s in symbols if s >= 0]

    def _word(self, word: str) -> bytes:
        """Ids of one word; the same word stands beside many kinds of punctuation."""
        found = self.new_words.get(word)
        if found is not None:
            return found
        found = self.old_words.get(word)
        if found is None:
            ids = self.word_ids(word)
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.new_words) >= REMEMBERED:
            self.old_words, self.new_words = self.new_words, {}
        self.new_words[word] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of a run without white space."""
        found = self.new.get(chunk)  # it may have come up since the text was looked up
        if found is not None:
            return found
        found = self.old.get(chunk)
        if found is None:
            if chunk.isascii() and chunk.isprintable():  # these bytes stand for themselves
                words = self.words.findall(chunk)
            elif not FAR.search(chunk):
                words = [w.encode("utf-8").decode("latin-1").translate(self.letters) for w in self.words.findall(chunk)]
            else:
                words = [w for w, _ in self.split(chunk)]
            found = self._word(words[0]) if len(words) == 1 else b"".join(map(self._word, words))
        if len(self.new) >= REMEMBERED:
            self.old, self.new = self.new, {}
        self.new[chunk] = found
        return found

    def _plain(self, text: str) -> list[bytes]:
        if not text.isascii() and FAR.search(text):
            chunks = self.normalise(text).split(" ")
        else:
            text = unicodedata.normalize("NFC", text)
            # Python counts four control characters as white space that a tokenizer does not.
            chunks = WHITE.sub(" ", text).lower().split(" ") if SEPARATORS.search(text) else text.lower().split()
        known = self.new
        found = [known.get(c) for c in chunks]
        if None in found:
            found = [self._chunk(c) if f is None else f for c, f in zip(chunks, found)]
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the text that they decode to."""
        if self.specials is None or "<" not in text:
            parts = self._plain(text)
        else:
            parts, start = [], 0
            for m in self.specials.finditer(text):
                parts += self._plain(text[start : m.start()])
                parts.append(self.special[m[0]].to_bytes(4, "little"))
                start = m.end()
            parts += self._plain(text[start:])
        ids = b"".join(parts)
        return ids, " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def loaded(path: str) -> WordBpe:
    """The worker's copy of a tokenizer; read once and kept for its later tasks."""
    return kept(("bpe", path), lambda: WordBpe(path))


def _map(df: DataFrame, id_column: str, text_column: str, path: str, ddl: str, schema: pa.Schema, columns) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            start, size, coded = 0, 0, []
            for at, text in enumerate(batch.column(1), 1):
                coded.append(bpe.encode(text.as_py() or ""))
                size += len(coded[-1][0]) + len(coded[-1][1])
                if size >= PIECE or at == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, at - start), *columns(coded)], schema=schema)
                    start, size, coded = at, 0, []

    bound_batches(df.sparkSession)
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, ddl)


def encode_texts(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of each row.

    A narrow step: no shuffle. Null and empty texts give no ids and an empty decoded text. Strings of special
    tokens inside a text become their ids. Repeated rows give repeated results; rows without an id keep a
    null id; an empty table gives no rows. Further columns are ignored. ``path`` must be readable by workers.
    """
    schema, ddl = arrow_schema(doc_id="long", ids="array<int>", decoded="string")

    def columns(coded: list[tuple[bytes, str]]) -> list[pa.Array]:
        ends = np.cumsum([0, *(len(ids) // 4 for ids, _ in coded)])
        ids = np.frombuffer(b"".join(ids for ids, _ in coded), "<i4")
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), pa.array([text for _, text in coded], pa.string())]

    return _map(df, id_column, text_column, path, ddl, schema, columns)


def encode_digests(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; edge cases as in ``encode_texts``."""
    schema, ddl = arrow_schema(doc_id="long", n_tokens="long", ids_sha256="string", decoded_sha256="string")

    def columns(coded: list[tuple[bytes, str]]) -> list[pa.Array]:
        return [
            pa.array([len(ids) // 4 for ids, _ in coded], pa.int64()),
            pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in coded], pa.string()),
            pa.array([hashlib.sha256(text.encode("utf-8")).hexdigest() for _, text in coded], pa.string()),
        ]

    return _map(df, id_column, text_column, path, ddl, schema, columns)
