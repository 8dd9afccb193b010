"""Ranked search, spelling variants and window dedup against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from prospectry.llm import ranked_search, spelling, window_dedup
from prospectry.llm.queries import LLM_QUERIES

DOCS = "doc_id long, text string, term string, n int, word string, bucket int, score long"  # with clashing names


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 3) for i, t in rows], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- ranked search ---------------------------------------------------------------------------


def plain_search(rows, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    texts = [(i, Counter(term.findall(lower(t or "")))) for i, t in rows]
    texts = [(i, c) for i, c in texts if c]
    docs, terms = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in texts:
            m = 25 + 75 * sum(c.values()) * docs // terms
            s = sum(math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in term.findall(lower(text or "")) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def search_rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["été", "ÉTÉ", "Σ", "中文", "don't", "a-b"]
    text = lambda n: " ".join(rng.choices(words, [1 / (1 + i) for i in range(len(words))], k=n)).replace("w1 ", "W1, ")
    rows = [(i, text(rng.randrange(0, 40))) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(150)]  # one text on a third of the rows
    rows += [(5, rows[5][1]), (5, "w3 w3 w9"), (None, "w1 w2 w3"), (600, None), (601, ""), (602, "..."), (603, text(20_000))]
    items = [(i, text(rng.randrange(1, 12))) for i in range(30)] + [(3, "w1 w2 w1"), (40, None), (41, ""), (42, "unknown"), (None, "w5 W5"), (43, rows[-1][1][:30_000])]
    return rows, items


@pytest.mark.parametrize("items_at_once, together", [(1024, 2048), (7, 50)])
def test_ranked_search(spark, monkeypatch, items_at_once, together):
    monkeypatch.setattr(ranked_search, "ITEMS", items_at_once)
    monkeypatch.setattr(ranked_search, "TOGETHER", together)
    monkeypatch.setattr(ranked_search, "SAMPLE", together)
    rows, items = search_rows(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    found = ranked_search.search(docs_of(spark, rows).repartition(3), asked, k=4)
    assert Counter(map(tuple, found.collect())) == plain_search(rows, items, 4)


def test_dual_tree_prunes(spark):
    """Far fewer pairs of nodes are followed than there are, and nothing is lost."""
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = [(np.arange(10 * i, 10 * i + 10), np.full(10, 1000)) for i in range(64)]
    tree = ranked_search.item_tree(vectors)
    search = ranked_search.Search(tree, np.full(640, 1000), np.ones(64, np.int64), 3)
    owner = np.repeat(np.arange(2048), 5)
    topic = np.repeat(rng.integers(0, 64, 2048), 5)
    terms = topic * 10 + np.tile(np.arange(5), 2048)
    values = np.repeat(rng.integers(1, 1000, 2048), 5)
    search.add(np.arange(2048), owner, terms, values)
    for i in range(64):
        best = sorted(((-5000 * int(values[5 * d]), d) for d in range(2048) if topic[5 * d] == i))[:3]
        assert sorted((-s, -d) for s, d in search.best[i]) == best
    leaves = 2048 // ranked_search.DOC_LEAF * 64 // ranked_search.ITEM_LEAF
    assert search.visited < leaves / 3


def test_ranked_search_of_nothing(spark):
    rows, items = search_rows(4)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert ranked_search.search(docs_of(spark, rows).limit(0), asked).collect() == []
    assert ranked_search.search(docs_of(spark, rows), asked.limit(0)).collect() == []


# --- spelling variants -------------------------------------------------------------------------


def plain_variants(rows):
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                count[w] += 1
    count = {w: n for w, n in count.items() if n >= 2}
    letters = sorted({c for w in count for c in w})
    near = {}
    for w in count:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        edits |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = (edits - {w}) & count.keys()
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-count[x], x), default=None)
        if best is not None and count[best] >= 10 * count[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(near[w]), count.get(form.get(w))) for w, n in count.items()}


def spelling_rows():
    rng = random.Random(5)
    words = ["streetlight", "harbouring", "Çapitalism", "mountains", "aaaaaaaa", "ÿÿÿÿÿÿÿÿ", "différence"]
    rows = []
    for i in range(700):
        w = rng.choice(words)
        if i % 9 == 0:
            at = rng.randrange(len(w))
            w = w[:at] + rng.choice("abcé") + w[at + i % 2 :]
        rows.append((i, f"{w.upper() if i % 3 else w}, {rng.choice(words)} short-{w}é7{w}"))
    rows += [(2000 + i, "chainaaaa") for i in range(300)] + [(3000 + i, "chainaaab") for i in range(25)] + [(4000 + i, "chainaacb") for i in range(2)]
    rows += [(9000 + i, "q" * 30_000 + " " + "q" * 29_999 + "r") for i in range(2)]  # very long words
    return rows + [(1, None), (2, ""), (None, "mountains mountaims"), (None, "mountaims"), (7, rows[7][1]), (7, rows[7][1])]


@pytest.mark.parametrize("filter_words", [8_000_000, 40])
def test_spelling_variants(spark, filter_words):
    rows = spelling_rows()
    found = spelling.variants(docs_of(spark, rows).repartition(3), filter_words=filter_words).collect()
    plain = plain_variants([r for r in rows if not (r[1] or "").startswith("qqq")])
    assert {r.word: tuple(r)[1:] for r in found if not r.word.startswith("qqq")} == plain
    assert any(form != root for form, root, *_ in plain.values() if form)  # a chain of two forms
    assert {(r.n, r.n_near, r.form) for r in found if r.word.startswith("qqq") and len(r.word) == 30_000} == {(2, 1, None)}
    assert len(found) == len({r.word for r in found})


def test_spelling_of_nothing(spark):
    docs = docs_of(spark, spelling_rows())
    assert spelling.variants(docs.limit(0)).collect() == []
    assert spelling.variants(docs.filter("text IS NULL OR text = ''")).collect() == []


def test_filters_hold_every_word(spark):
    words = spark.createDataFrame([(f"{'abcdefg'[i % 7]}{i:09d}".translate(str.maketrans("0123456789", "hijklmnopq")),) for i in range(20_000)], "word string")
    filters = spelling.Filters({10: 20_000})
    filters.blocks = spelling.build_filters(words, filters)
    letters = spelling.letters_of([r[0] for r in words.collect()])
    block, number = filters.place(10, ((letters.astype(spelling.U) + spelling.U(1)) * spelling.powers(10)).sum(1, dtype=spelling.U))
    bits = spelling.patterns()[number]
    assert (filters.blocks[block] & bits == bits).all()
    other = spelling.letters_of([r[0][::-1] + "z" for r in words.limit(5000).collect()])[:, 1:]
    block, number = filters.place(10, ((other.astype(spelling.U) + spelling.U(1)) * spelling.powers(10)).sum(1, dtype=spelling.U))
    bits = spelling.patterns()[number]
    assert (filters.blocks[block] & bits == bits).mean() < 0.01


# --- window dedup ------------------------------------------------------------------------------


def plain_windows(rows, width):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, words in split:
        for k in range(len(words) - width + 1):
            w = tuple(words[k : k + width])
            first[w] = min(first.get(w, order(i)), order(i))
    out = Counter()
    for i, words in split:
        gone = set()
        for k in range(len(words) - width + 1):
            if first[tuple(words[k : k + width])] < order(i):
                gone.update(range(k, k + width))
        out[i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)] += 1
    return out


def window_rows():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)] + ["été", "\x85", "a\xa0b"]
    text = lambda n: rng.choice([" ", "\n", "\t\v", "  "]).join(rng.choices(words, k=n))
    passage, line = text(40), text(9)
    rows = [(i, text(rng.randrange(0, 60))) for i in range(120)]
    rows += [(1000 - i, f"{text(rng.randrange(20))} {passage} {text(rng.randrange(20))}") for i in range(60)]  # a third hold one passage
    rows += [(2000 + i, f"{text(12)} {line} {text(12)}") for i in range(60)]  # and many a line that is shorter than a window
    rows += [(3000 + i, text(1) + " loop loop" * rng.randrange(5, 40)) for i in range(10)]
    rows += [(3, rows[3][1]), (3, passage), (None, passage), (None, passage + " x"), (4, None), (5, ""), (4000, text(3000) + " " + passage), (9, rows[50][1])]
    return rows


@pytest.mark.parametrize("options", [{}, {"crowded": 3, "bucket_bytes": 4000}, {"gram": 13, "bucket_bytes": 20_000}, {"gram": 1, "crowded": 10}])
def test_window_dedup(spark, options):
    rows = window_rows()
    found = window_dedup.remove_windows(docs_of(spark, rows).repartition(4), **options)
    assert Counter(map(tuple, found.collect())) == plain_windows(rows, 13)


def test_window_dedup_other_widths(spark):
    rows = window_rows()
    for width in (2, 7, 70):
        found = window_dedup.remove_windows(docs_of(spark, rows), window=width, gram=2)
        assert Counter(map(tuple, found.collect())) == plain_windows(rows, width)


def test_window_dedup_of_nothing(spark):
    docs = docs_of(spark, window_rows())
    assert window_dedup.remove_windows(docs.limit(0)).collect() == []
    assert all(r.n_removed == r.n_words == 0 for r in window_dedup.remove_windows(docs.filter("coalesce(text, '') = ''")).collect())


# --- the registered queries ----------------------------------------------------------------------


def test_registered_queries(spark, tmp_path):
    rows = [r for r in window_rows() if r[0] is not None] + [r for r in spelling_rows()[:400]]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, "w1 w2 w3"), (2, rows[130][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = lambda name: LLM_QUERIES[name](spark, str(tmp_path))
    assert Counter(map(tuple, run("op11_ranked_search").collect())) == plain_search(rows, items, 10)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in run("op12_spelling_variants").collect()} == plain_variants(rows)
    plain = Counter()
    for (i, n, gone, kept), times in plain_windows(rows, 13).items():
        plain[i, n, gone, hashlib.sha256(kept.encode()).hexdigest()] += times
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in run("op13_window_dedup").collect()) == plain
