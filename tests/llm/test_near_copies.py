"""The pipeline's near-dedup stage against all pairs compared."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from prospectry.llm import near_copies


def plain_shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def plain_kept(rows):
    sets = [plain_shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old = label[j]
                label = [label[i] if x == old else x for x in label]
    least = {g: min((i for (i, _), x in zip(rows, label) if x == g and i is not None), default=None) for g in label}
    return Counter((i, t) for (i, t), x in zip(rows, label) if i is None or i == least[x])


def made_rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    rows = []
    for k in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 9, 80, 300]))]
        if k % 3 == 0:
            base[:0] = passage  # common to many texts that are no near copies
        for _ in range(rng.randrange(1, 5)):
            text = list(base)
            for _ in range(rng.choice([0, 1, len(text) // 50, len(text) // 40, len(text) // 30])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows) * 3, " ".join(text)))
    return rows + [(5000, None), (5001, ""), (5002, "A b"), (5003, "a B"), (None, rows[4][1]), (None, "alone w1")]


def test_stage_is_what_all_pairs_give(spark, sf):
    rows = made_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "node": F.lit("x")}).repartition(5)
    kept = corpus_pipeline.near_dedup_stage(spark, docs, sf)
    expected = plain_kept(rows)
    assert kept.columns == docs.columns and len(expected) < len(rows) - 40
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == expected
    assert near_copies.drop_near_copies(docs.limit(0)).collect() == []


def test_any_order_of_shingles_and_long_lists(monkeypatch):
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 4, 30, 200, 200)]
    sets = []
    for k in range(60):
        own = base[k % 5].copy()
        own[rng.random(len(own)) < 0.06] = rng.integers(0, 2**63)
        sets.append(np.unique(own))
    common = np.sort(np.concatenate(base)[::3])
    often = rng.integers(1, 9, len(common))
    firsts = [set(near_copies.first_shingles(s, common, often).tolist()) for s in sets]
    pairs = [(i, j) for i in range(60) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    assert len(pairs) > 50 and all(firsts[i] & firsts[j] for i, j in pairs)

    monkeypatch.setattr(near_copies, "BLOCK", 7)
    key, node = np.full(60, 5, np.uint64), np.arange(60)
    blocks = pd.DataFrame({"keys": [near_copies.pack(key)], "nodes": [pa.compress(node.tobytes(), codec="zstd", asbytes=True)]})
    label = list(range(60))
    for r in near_copies._lists(blocks).itertuples():
        assert len(r.nodes) <= 14
        for i, j in near_copies.forest([sets[n] for n in r.nodes], r.cut):
            a, b = label[r.nodes[i]], label[r.nodes[j]]
            label = [a if x == b else x for x in label]
    whole = list(range(60))
    for i, j in pairs:
        a, b = whole[i], whole[j]
        whole = [a if x == b else x for x in whole]
    assert len(set(zip(label, whole))) == len(set(label)) == len(set(whole))


def test_other_texts_under_a_shared_id_stay(spark, sf):
    """A near copy goes by id and text; an unrelated text with its id is judged by itself."""
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "quite another text that nobody else has"), (3, "a b c d e f g h i"), (3, "a b c d e f g h i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit("theirs"))
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([rows[0], rows[2]])


def test_contaminated_texts_under_a_shared_id(spark):
    from prospectry.llm import decontaminate

    rng = random.Random(2)
    words = [f"v{i}" for i in range(500)]
    item = " ".join(rng.choice(words) for _ in range(40))
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(30)]
    rows += [(3, f"{rows[1][1]} {item}"), (None, item), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert Counter(map(tuple, kept.collect())) == Counter(r for r in rows if r != rows[30])


def test_the_index_gives_candidates_and_links_are_checked(spark):
    """Near copies within two bits come from the SimHash index itself; texts that only share a fingerprint are not linked."""
    rng = random.Random(4)
    words = [f"x{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(1500)]
    near = [*base[:-1], "other"]
    far = [rng.choice(words) for _ in range(1500)]
    sets = [near_copies.shingles(" ".join(t).encode()) for t in (base, base, near, far)]
    prints = [near_copies.fingerprint(s) for s in sets]
    assert prints[0] == prints[1] and (prints[0] ^ prints[2]).bit_count() <= near_copies.BITS < (prints[0] ^ prints[3]).bit_count()
    nodes = spark.createDataFrame([*enumerate(prints), (9, prints[0])], "node long, fp long").repartition(3)
    found = [(*sorted(r.nodes), r.cut) for r in near_copies.index_lists(nodes).collect()]
    label = list(range(10))
    for a, b, cut in found:
        assert cut == 0
        label = [label[a] if x == label[b] else x for x in label]
    assert len({label[k] for k in (0, 1, 2, 9)}) == 1 and label[3] not in {label[0], label[9]}
    assert near_copies.index_lists(nodes.limit(0)).collect() == []
    # The same fingerprint stands beside sets that differ: whole sets decide.
    assert near_copies.forest([sets[0], sets[3]], 0) == [] and near_copies.forest([sets[0], sets[2]], 0) == [(0, 1)]
