"""Near-dedup leaves one text of each group, whatever ids its rows have; nothing that only shares an id goes."""

from collections import Counter

import corpus_pipeline


def test_linked_texts_under_one_id_or_none(spark, sf):
    words = [f"w{i}" for i in range(60)]
    base, near, far = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(reversed(words))
    other, close = " ".join(w + "o" for w in words), " ".join([*(w + "o" for w in words[:-1]), "y"])
    rows = [(1, base), (1, near), (1, far), (4, near), (None, other), (None, close), (None, base), (7, None), (7, ""), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup_stage(spark, docs, sf).collect())
    # The id alone does not tell linked texts apart: one of them stays, and so does one of those without an id.
    assert kept[1, base] + kept[1, near] == 1 and kept[4, near] == 0 and kept[1, far] == 1
    assert kept[None, other] + kept[None, close] == 1 and kept[None, base] == 1
    assert (kept[7, None], kept[7, ""], kept[8, ""]) == (1, 1, 0)
    assert sum(kept.values()) == 6


def test_every_pair_at_the_bound_is_found(spark, sf):
    """Pairs of texts just above and just below a similarity of 0.8, far beyond what the SimHash index reaches."""
    rows, gone = [], set()
    for k in range(40):
        n, own = 100 + k, [f"t{k}w{i}" for i in range(100 + k)]
        shingles = n - 4
        # Other words at the end change as many shingles on both sides: similar while 5 * (s - c) >= 4 * (s + c).
        most = shingles // 9
        for j, changed in enumerate((most, most + 1)):
            rows += [(10 * k + 4 * j, " ".join([f"p{j}{w}" for w in own])), (10 * k + 4 * j + 1, " ".join([f"p{j}{w}" for w in own[: n - changed]] + [f"z{k}{j}{i}" for i in range(changed)]))]
        gone.add(10 * k + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, sf).collect()}
    assert kept == {i for i, _ in rows} - gone
