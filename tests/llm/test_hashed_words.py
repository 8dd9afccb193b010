"""Decontamination counts and numbers words by hashes of whole stretches of text: they are the words of ``words_of``."""

import random
from collections import Counter

import numpy as np
import pytest

from prospectry.llm import decontaminate

ODD = [b"", b" ", b"\xff\x00 a,b.c! \x1c x\x85y a\x00 a", b"." * 5, "Äé A\tB\x0bb".encode(), b"q" * 3000 + b" Z z", bytes(random.Random(1).randrange(256) for _ in range(4000))]


@pytest.mark.parametrize("chunk", [1, 64, 1 << 18])
def test_words_of_odd_texts(monkeypatch, chunk):
    monkeypatch.setattr(decontaminate, "CHUNK", chunk)
    hashes, sizes, joined, begin, end = decontaminate.hashes_of(ODD)
    expected = [decontaminate.words_of(t) for t in ODD]
    assert [joined[a:b] for a, b in zip(begin.tolist(), end.tolist())] == [w for words in expected for w in words]
    assert sizes.tolist() == list(map(len, expected))
    by_word = dict(zip((w for words in expected for w in words), hashes.tolist()))
    assert len(set(by_word.values())) == len(by_word) and [by_word[w] for words in expected for w in words] == hashes.tolist()
    found = decontaminate._distinct(ODD)
    assert dict(zip(found[2].to_pylist(), found[1].tolist())) == Counter(w for words in expected for w in set(words))


def test_numbers_of_words():
    terms = {f"w{i}".encode(): i for i in range(0, 3000)}
    words = [f"w{i}".encode() for i in range(2900, 3100)]
    numbers = decontaminate.Numbers(terms).of(decontaminate.hashes_of([b" ".join(words)])[0])
    assert numbers.tolist() == [min(i, 3000) for i in range(2900, 3100)]
    assert decontaminate.Numbers({}).of(np.arange(3, dtype=np.uint64)).tolist() == [0, 0, 0]


def test_counts_of_many_sendings(spark, monkeypatch):
    for name, value in (("CHUNK", 50), ("GROUP", 100), ("RUN_WORDS", 60), ("MORE_WORDS", 10**6)):
        monkeypatch.setattr(decontaminate, name, value)
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(30))) for _ in range(200)] + [None, ""]
    terms, idf = decontaminate.vocabulary(spark.createDataFrame([(t,) for t in texts], "text string"), [[b"none"]])
    df = Counter(w for t in texts for w in set((t or "").encode().split()))
    assert set(terms) == {*df, b"none"}
    assert np.allclose([idf[terms[w]] for w in terms], [np.log(203 / (1 + df[w])) + 1e-3 for w in terms])
