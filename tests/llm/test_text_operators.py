"""BPE, exact dedup, SimHash, toxicity, decontamination and language model on small tables, against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prospectry.llm import bpe, decontaminate, exact_dedup, ngram_lm, simhash, toxicity
from prospectry.llm.components import components
from prospectry.llm.elias_fano import EliasFano

PATH = public_tokenizers.path("word_bpe_49k.json")
#: Extra columns whose names also occur inside the operators.
CLASH = {"id": "'x'", "_id": "1", "norm": "2", "digest": "3", "fp": "4", "salt": "5", "_digest": "6", "keep_id": "7", "lang": "'en'", "_hash": "8"}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.expr(v) for k, v in CLASH.items()})


ODD = [(1, "Same Text"), (2, "same text"), (3, None), (4, ""), (5, "SAME TEXT"), (None, "same text"), (6, "É"), (7, "é"), (7, "é"), (8, "x " * 60_000), (None, None)]


def plain_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_bpe_is_what_the_library_gives(spark):
    rng = random.Random(4)
    texts = ["", " \n", "It's IT'S we'll", "<|endoftext|>a<|startoftext|> <|x|>", "ΑΣ İ ǅ ﬁ", "a\x1cb\x85c\xa0d", "e\u0301 é", "१२ ½ 😀👍🏽", "w" * 3000]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0xD7FF), rng.randrange(0xE000, 0x2FFFF), 32])) for _ in range(40)) for _ in range(400)]
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    rows = {r.doc_id: r for r in bpe.encode_texts(table(spark, list(enumerate(texts))), PATH).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert rows[i].ids == ids and rows[i].decoded == library.decode(ids, skip_special_tokens=False)
    odd = bpe.encode_digests(table(spark, ODD), PATH).collect()
    assert len(odd) == len(ODD) and {r.n_tokens for r in odd if r.doc_id in (3, 4)} == {0}
    assert bpe.encode_digests(table(spark, []), PATH).collect() == []


@pytest.mark.parametrize("digest_chars", [64, 1])
def test_exact_groups(spark, digest_chars):
    rows = ODD + [(100 + i, f"Text {i % 7}") for i in range(60)]
    found = exact_dedup.exact_groups(table(spark, rows), digest_chars=digest_chars).collect()
    expected = Counter()
    for i, text in rows:
        norm = plain_lower(text)
        same = [j for j, t in rows if plain_lower(t) == norm]
        keep = max([j for j in same if j is not None], default=None)
        expected[i, keep, len(same), i == keep, hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == expected
    assert exact_dedup.exact_groups(table(spark, [])).collect() == []


def test_drop_copies_keeps_one_row_of_each_text(spark):
    for rows in (ODD, [(i, f"t{i % 3}") for i in range(9)], []):
        df = table(spark, rows)
        kept = exact_dedup.drop_copies(df)
        assert kept.columns == df.columns
        assert Counter(plain_lower(r.text) for r in kept.collect()) == Counter({plain_lower(t) for _, t in rows})


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if b < a and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_near_groups(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 60, 200]))] for _ in range(25)]
    rows = []
    for i in range(120):
        text = list(rng.choice(base))
        if rng.random() < 0.5:
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i * 3, " ".join(text)))
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "A b"), (1004, "a B")]
    prints = {i: plain_fingerprint(t) for i, t in rows}
    roots = smallest(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    for leaf in (4096, 4):
        found = simhash.near_groups(table(spark, rows), leaf=leaf).collect()
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {i: (f"{prints[i]:016x}", roots[i]) for i in prints}
    kept = simhash.keep_first(table(spark, rows))
    assert {r.doc_id for r in kept.collect()} == set(roots.values()) and kept.columns == table(spark, []).columns
    assert len(simhash.near_groups(table(spark, ODD)).collect()) == len(ODD)
    assert simhash.near_groups(table(spark, [])).collect() == []


def test_links_with_dense_groups_and_split_prefixes(spark):
    rng = np.random.default_rng(2)
    codes = set()
    for start in rng.integers(0, 2**63, 12).tolist():
        for _ in range(40):
            codes.add(start)
            start ^= 1 << int(rng.integers(63))
    edges = simhash.links(spark.createDataFrame([(c,) for c in codes], "fp long"), 2, 3)
    found = {r.node: r.root for r in components(edges, "a", "b").collect()}
    assert {c: found.get(c, c) for c in codes} == smallest(sorted(codes), lambda a, b: (a ^ b).bit_count() <= 2)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 900), (901, 905), (None, 3)], "a long, b long")
    found = {r.node: r.root for r in components(edges, "a", "b").collect()}
    assert found == {**{i: 0 for i in range(301)}, 901: 901, 905: 901}


def test_toxicity_finds_held_out_words_and_stems(spark):
    rng = random.Random(3)
    plain = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "ame") for b in ("um", "em", "at", "or", "is", "us")]
    bad = ["zonk"] + [f"grumpf{x}" for x in "abcdefghijkl"]
    rows, labels = [], []
    for i in range(500):
        words = [rng.choice(plain) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = table(spark, rows)
    train = spark.createDataFrame([x for x in labels if x[0] < 400] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, train)
    scores = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    held = [i for i in range(400, 500)]
    assert sum((scores[i] >= 0.5) == (i % 5 == 0) for i in held) >= 97
    odd = toxicity.score_texts(table(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s < model.thresholds.get("en", model.threshold)}
    # Thresholds come from all labelled rows that were not fitted on, here most of them, and tell the classes apart.
    small = toxicity.train(docs, train, sample=120)
    scored = toxicity.score_texts(docs, small, lang_column="lang")
    judged = toxicity.calibrate(scored, train, small, sample=120)
    by_id = {r.doc_id: (r.score, r.t) for r in scored.withColumn("t", toxicity.threshold_of(judged, F.col("lang"))).collect()}
    fitted = {i for i, _ in labels if i < 400} - {r[0] for r in train.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id").collect()}
    assert not fitted
    f1 = lambda limit: (lambda hit, called, true: 2 * hit / (called + true))(
        sum(s >= limit(i) and i % 5 == 0 for i, (s, _) in by_id.items()), sum(s >= limit(i) for i, (s, _) in by_id.items()), 100)
    assert f1(lambda i: by_id[i][1]) >= max(f1(lambda i: small.limit("en")), f1(lambda i: 0.5)) - 0.03
    assert toxicity.calibrate(scored, train.limit(0), small).threshold == small.threshold
    nothing = toxicity.train(docs, train.limit(0))
    assert {r.score < 0.5 for r in toxicity.score_texts(docs, nothing).collect()} == {True}


def test_pieces_of_long_texts_score_as_a_whole():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)).astype(np.float32)
    filters = [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    model = toxicity.Model(rows, filters, [np.zeros(toxicity.FILTERS, np.float32)] * 3, rng.normal(size=36).astype(np.float32))
    words = [f"w{i}" for i in range(toxicity.PIECE * 2 + 77)]
    whole = model.pooled(model.rows[np.array([toxicity.word_rows(w) for w in words])].sum(1), np.array([len(words)]))
    assert np.allclose(toxicity.Scorer(model).score(["a b", " ".join(words)])[1], model.score(whole)[0], atol=1e-5)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_decontamination(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(words if rng.random() < 0.6 else words[:30]) for _ in range(n)]
    items = {i: text(rng.choice([15, 38, 59])) for i in range(20)}
    rows, leaks = [], set()
    for i in range(200):
        doc = text(rng.choice([0, 5, 100, 700]))
        if i % 5 == 0:
            k = rng.randrange(20)
            leak = [w for w in items[k]]
            if i % 10 == 0:  # a paraphrase: some words replaced, the answer left
                for _ in range(len(leak) // 5):
                    leak[rng.randrange(len(leak) * 3 // 4)] = "new"
            at = rng.randrange(len(doc) + 1)
            doc[at:at] = leak
            leaks.add((i, k))
        rows.append((i, " ".join(doc).capitalize() + "."))
    rows += [(500, None), (501, ""), (None, " ".join(items[3]))]
    bench = spark.createDataFrame([*((k, " ".join(v)) for k, v in items.items()), (90, None), (91, "  "), (None, "a b c d")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    docs = table(spark, rows)
    found = decontaminate.matches(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == leaks | {(None, 3)}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in leaks}
    assert decontaminate.matches(docs, bench.limit(0)).collect() == [] and decontaminate.matches(docs.limit(0), bench).collect() == []
    for _ in range(50):
        a, b = [rng.choice("abcd").encode() for _ in range(12)], [rng.choice("abcde").encode() for _ in range(30)]
        assert decontaminate.common(decontaminate.places(a), len(a), b) == lcs(a, b)


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (1, 2**62), (1000, 1200), (1000, 2**40), (64, 10**3), (5000, 2**62)):
        values = np.unique(rng.integers(0, top, n))
        coded = EliasFano.of(values)
        assert (coded.access(np.arange(len(values))) == values).all() and (coded.find(values) == np.arange(len(values))).all()
        asked = rng.integers(0, top + 5, 500)
        place = {v: i for i, v in enumerate(values.tolist())}
        assert coded.find(asked).tolist() == [place.get(v, -1) for v in asked.tolist()]


@pytest.mark.parametrize("small", [False, True])
def test_language_model_against_plain_counts(spark, monkeypatch, small):
    if small:  # many shards and runs
        monkeypatch.setattr(ngram_lm, "SHARD_BYTES", 3000)
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("the a Of cat dog sat on mat é x9".split()) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (None, "The cat unseen"), (7, "repeated row"), (7, "repeated row")]
    docs = table(spark, rows)
    held = F.coalesce(F.col("doc_id") % 3 == 1, F.lit(False))
    model, coded = ngram_lm.train(docs, held, least=2)
    assert coded.count() == len(rows)
    found = ngram_lm.score_texts(docs, model).collect()
    tokens = [((i, t), [*(t or "").encode().lower().split(), b""]) for i, t in rows]
    train = [t for (i, _), t in tokens if i is None or i % 3 != 1]
    one = Counter(w for t in train for w in t)
    two = {k: v for k, v in Counter(p for t in train for p in zip(t, t[1:])).items() if v >= 2}
    three = {k: v for k, v in Counter(p for t in train for p in zip(t, t[1:], t[2:])).items() if v >= 2}
    n, v, d = sum(one.values()), len(one), ngram_lm.DISCOUNT
    off2 = {w: 1 - sum(c - d for (a, _), c in two.items() if a == w) / one[w] for w in one}
    off3 = {p: 1 - sum(c - d for k, c in three.items() if k[:2] == p) / two[p] for p in two}
    p1 = lambda w: (one.get(w, 0) + 1) / (n + v + 1)
    p2 = lambda a, w: (two[a, w] - d) / one[a] * ((a, w) in two) + off2[a] * p1(w) if (a, w) in two else off2.get(a, 1) * p1(w)
    p3 = lambda a, b, w: ((three.get((a, b, w), d) - d) / two[a, b] + off3[a, b] * p2(b, w)) if (a, b) in two else p2(b, w)
    assert (model.tokens, model.distinct) == (n, v) and len(found) == len(rows)
    expected = Counter()
    for (i, _), t in tokens:
        base = sum(math.log10(p1(w)) for w in t)
        score = sum(math.log10(p1(w) if k == 0 else p2(t[0], w) if k == 1 else p3(t[k - 2], t[k - 1], w)) for k, w in enumerate(t))
        expected[i, len(t), sum(w in one for w in t), round(base, 6)] += 1
        mine = [r for r in found if r.doc_id == i and abs(r.base_score - base) < 1e-6]
        assert any(abs(r.score - score) < 0.04 * len(t) for r in mine)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == expected


def test_language_model_of_nothing(spark):
    docs = table(spark, ODD)
    model, _ = ngram_lm.train(docs.limit(0), F.lit(False))
    assert model.tokens == 0 and all(r.n_known == 0 and r.score == r.base_score == 0 for r in ngram_lm.score_texts(docs, model).collect())


def test_an_id_with_many_rows_is_one_row_of_the_sample(spark):
    """The sample is bounded in rows: one text of each chosen id, the same in every run."""
    docs = table(spark, [(1, f"word{i} other") for i in range(300)] + [(2, "zonk zonk"), (2, "zonk")])
    train = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    one, two = (toxicity.train(docs.repartition(n), train, sample=2) for n in (1, 4))
    assert (one.rows == two.rows).all() and one.bias == two.bias


def test_benchmark_items_with_repeated_words(spark):
    """Words count as often as the item has them; and an item is found whatever other items there are."""
    item = " ".join(["tick"] * 20 + [f"u{i}" for i in range(10)])
    other = [(100 + i, " ".join(f"x{i}y{j}" for j in range(30))) for i in range(600)]
    docs = table(spark, [(1, "tick " * 20 + "and then " + " ".join(f"u{i}" for i in range(3))), (2, "quite different words " * 10)])
    found = {}
    for more in ([], other):
        bench = spark.createDataFrame([(7, item), *more], "item_id long, text string")
        found[len(more)] = [(r.doc_id, r.item_id, round(r.lcs, 6)) for r in decontaminate.matches(docs, bench, cosine=0.3).collect()]
    assert found[0] == found[600] == [(1, 7, round(23 / 30, 6))]


def test_crowded_regions_and_their_neighbours(spark):
    """Half of the fingerprints share their first bits, others lie one flip beside them; links are those of all pairs."""
    rng = random.Random(6)
    crowd = [0xABC << 52 | rng.getrandbits(14) for _ in range(400)]
    beside = [(0xABC ^ 1 << rng.randrange(12)) << 52 | (x & (1 << 52) - 1) ^ (1 << rng.randrange(14) if rng.random() < 0.5 else 0) for x in rng.sample(crowd, 60)]
    codes = sorted({*crowd, *beside, *(rng.getrandbits(64) for _ in range(300))})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    root = {x: x for x in codes}
    for i, x in enumerate(codes):
        for y in codes[:i]:
            if (x ^ y).bit_count() <= 2 and root[x] != root[y]:
                a, b = sorted((root[x], root[y]))
                root = {k: a if v == b else v for k, v in root.items()}
    df = spark.createDataFrame([(signed(x),) for x in codes], "fp long")
    for leaf in (4, 20):
        found = {r.node: r.root for r in components(simhash.links(df, 2, leaf), "a", "b").collect()}
        groups = lambda of: {frozenset(g) for g in _grouped(of).values() if len(g) > 1}
        assert groups({signed(x): r for x, r in root.items()}) == groups({signed(x): found.get(signed(x), signed(x)) for x in codes})


def _grouped(of):
    out = {}
    for k, v in of.items():
        out.setdefault(v, set()).add(k)
    return out
