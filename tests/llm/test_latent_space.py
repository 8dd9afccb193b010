"""The latent space of the decontamination comes from all documents, not from some of them."""

import random

import numpy as np
import pyarrow as pa

from prospectry.llm import decontaminate


def test_terms_and_frequencies_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MORE_WORDS", 3)
    # 2,400 texts; "often" is in the last 600 alone, "some" in fewer than those.
    rows = [(i, f"only{i} " + ("often, Often" if i >= 1800 else "") + (" some" if i % 5 == 0 else "")) for i in range(2400)] + [(None, "often some"), (5, None)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(5)
    terms, idf = decontaminate.vocabulary(docs.select("text"), [[b"item", b"some"], [b"item"]])
    assert set(terms) == {b"item", b"some", b"often", next(iter(set(terms) - {b"item", b"some", b"often"}))} and len(terms) == 4
    frequency = {b"item": 0, b"some": 481, b"often": 601}
    assert np.allclose([idf[terms[w]] for w in frequency], [np.log(2403 / (1 + n)) + 1e-3 for n in frequency.values()])
    coded = {r.id: decontaminate.decoded(pa.array([r.ids]), 4)[0].tolist() for r in decontaminate.encode(docs.filter("id IS NOT NULL"), terms).collect() if r.id >= 1800}
    assert all(words[1:3] == [terms[b"often"]] * 2 and (len(words) == 4) == (i % 5 == 0) for i, words in coded.items())


def test_products_are_those_of_the_whole_matrix(monkeypatch):
    monkeypatch.setattr(decontaminate, "ROWS", 50)
    rng = np.random.default_rng(1)
    none = 70
    rows = np.minimum(rng.zipf(1.3, (170, 32)) - 1, none).astype(np.uint16)
    rows[7] = none  # a passage of other words alone
    idf = rng.random(none)
    basis = np.append(rng.normal(size=(none, 9)), np.zeros((1, 9)), axis=0).astype(np.float32)
    counts = np.stack([np.bincount(r, minlength=none + 1)[:none] for r in rows])
    length = np.sqrt((counts**2 * idf**2).sum(1, keepdims=True))
    plain = np.divide(counts, length, out=np.zeros(counts.shape), where=length > 0)
    for often in (1, 32, 10**6):
        monkeypatch.setattr(decontaminate, "OFTEN", often)
        total = np.zeros((none + 1, 9))
        decontaminate._add_products(rows, basis, np.append(idf**2, 0), total)
        assert np.allclose(total[:none], plain.T @ (plain @ basis[:none]), atol=1e-3)
    y = plain @ (idf[:, None] * basis[:none])
    assert np.allclose(decontaminate._inner_products(rows, np.append(idf, 0).astype(np.float32)[:, None] * basis, np.append(idf**2, 0)), y.T @ y, atol=1e-3)


def test_directions_of_all_documents(spark):
    """Two groups of words, the second in the last of 2,500 texts only: the main directions are those of the whole matrix."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice([f"{'ab'[i >= 2200]}{k}" for k in range(8)]) for _ in range(40))) for i in range(2500)]
    docs = spark.createDataFrame(rows, "id long, text string")
    space, coded = decontaminate.fit(docs, [(1, b"a1 a2 a3 b1 b2 b3")], rank=4)
    texts = decontaminate.decoded(pa.array([r.ids for r in coded.collect()]), len(space.energy) - 1)
    n = len(space.energy) - 1
    passages = decontaminate.passages_of(texts, n)
    assert len(passages) == 5000
    idf = np.sqrt(space.energy[:n])
    counts = np.stack([np.bincount(p, minlength=n + 1)[:n] for p in passages]) * idf
    counts /= np.linalg.norm(counts, axis=1, keepdims=True)
    own = np.bincount(np.array(space.items[0][1]), minlength=n) * idf
    matrix = counts.T @ counts + decontaminate.OWN_WEIGHT * 5000 * np.outer(own, own) / (own @ own)
    expected = np.linalg.eigh(matrix)[1][:, -4:]
    found = space.project[:n] / idf[:, None]
    assert np.linalg.svd(expected.T @ found)[1].min() > 0.99
