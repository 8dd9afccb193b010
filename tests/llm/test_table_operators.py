"""URL filter, line dedup, sharding, suffix dedup and the registered queries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from prospectry.llm import line_dedup, sharding, suffix_dedup, url_filter
from prospectry.llm.queries import LLM_QUERIES, LLM_SQL


def plain_judge(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for rule, _ in url_filter.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def test_rules_and_trees(spark):
    rng = random.Random(1)
    hosts = ["EXAMPLE.com", "www.example.com", "a.www.example.com", "example.net", "xcom", "com", "shop.example.org", "É.com", "a.com:80"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/'])}{rng.choice(['en/', 'es/1', 'fr/x?y=/z', 'q', '?a/b', '#/en/'])}{rng.randrange(99)}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://", "http://a/b://c/d", "ftp://net/es/\nx", "http://" + "a" * 5000 + ".com/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "label": F.lit("x"), "_url": F.lit(2), "fold": F.lit(3)})
    found = {r.page_id: r for r in url_filter.judge(rows).collect()}
    blocks = dict(url_filter.RULES)
    assert len(found) == len(urls)
    for i, url in enumerate(urls):
        r = found[i]
        assert (r.host, r.path, r.rule) == plain_judge(url), url
        assert r.verdict == ("block" if blocks[r.rule] else "allow") if r.rule else r.verdict in ("allow", "block") and 0 <= r.score <= 1
    assert url_filter.judge(rows.limit(0)).collect() == []
    unlabelled = url_filter.judge(rows.filter("url LIKE '%.org%'")).collect()
    assert {r.verdict for r in unlabelled} == {"allow"}


def test_trees_learn_from_labelled_urls(spark):
    good = [(i, f"https://a{i % 9}.example.com/en/news/{i}") for i in range(300)]
    bad = [(1000 + i, f"http://b{i % 9}.example.net/es/{i}?p={i}&q=1&r=2") for i in range(300)]
    rules = [("example.com/", False), ("example.net/", True)]
    others = [(5000, "https://a3.example.org/en/news/77"), (5001, "http://b3.example.org/es/12?p=12&q=1&r=2")]
    found = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(good + bad + others, "page_id long, url string"), rules=rules).collect()}
    assert (found[5000], found[5001]) == ("allow", "block")


def test_boilerplate(spark):
    rng = random.Random(2)
    common = ["menu", "  ", "", "footer é", "once"]
    rows = [(i, "\n".join(rng.choice([*common, f"own {i} {k}"]) for k in range(rng.randrange(0, 12))), f"s{rng.randrange(9)}") for i in range(200)]
    rows += [(900, None, "s1"), (901, "", None), (902, "menu\nmenu", None), (None, "menu\nx", "s2"), (7, "menu", "s3"), (7, "menu", "s3"), (903, "edge\nz", "s1"), (904, "edge", "s2"), (905, "edge", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"key": F.lit(1), "a": F.lit(2), "gone": F.lit(3), "site": F.lit(4), "n": F.lit(5)})
    sites = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if s is not None and line.strip():
                sites[line].add(s)
    for least in (2, 3, 9):
        wide = {line for line, s in sites.items() if len(s) >= least}
        expected = Counter()
        for i, t, _ in rows:
            lines = (t or "").split("\n")
            kept = [x for x in lines if x not in wide]
            expected[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
        found = line_dedup.remove_boilerplate(df, min_sites=least, band=2.0)
        assert Counter(tuple(r) for r in found.collect()) == expected
    assert line_dedup.remove_boilerplate(df.limit(0)).collect() == []


def test_hypergeometric_draws():
    rng = np.random.default_rng(0)
    drawn = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(drawn) - 6) < 0.15 and abs(np.var(drawn) - 20 * 0.3 * 0.7 * 80 / 99) < 0.4
    big = sharding.hypergeometric(rng, 10**12, 3 * 10**12, 10**9)
    assert abs(big - 25 * 10**7) < 10**6
    rows = [100, 0, 7, 393]
    matrix = sharding.draw_matrix(rng, rows, np.array([125] * 4))
    assert matrix.sum(0).tolist() == [125] * 4 and matrix.sum(1).tolist() == rows


def test_shards(spark):
    rows = [(i, f"t{i % 40}") for i in range(500)] + [(3, "t3"), (None, None), (None, None), (600, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_hash": F.lit("h"), "_shard": F.lit(99), "upto": F.lit(1), "_row": F.lit(2)})
    runs = []
    for block_rows, parts in ((1 << 15, 3), (20, 3), (20, 7)):
        found = sharding.shuffle_into_shards(df.repartition(parts), 24, block_rows=block_rows)
        assert set(found.columns) == set(df.columns) | {"_slot"}
        got = found.collect()
        slots = defaultdict(list)
        for r in got:
            slots[r._shard].append(r._slot)
        assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
        assert set(slots) == set(range(24)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        runs.append(Counter((r.doc_id, r.text, r._shard, r._slot) for r in got))
        assert abs(np.corrcoef([r._shard for r in got if r.doc_id], [r.doc_id for r in got if r.doc_id])[0, 1]) < 0.2
    assert runs[1] == runs[2]  # however the table is partitioned
    assert sharding.shuffle_into_shards(df.limit(0)).collect() == []
    assert sharding.shuffle_into_shards(df.limit(5), 24).count() == 5


def plain_repeats(rows, length):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    for i, t in sorted(texts, key=lambda x: order(x[0])):
        for p in range(len(t) - length + 1):
            first[t[p : p + length]] = min(first.get(t[p : p + length], (order(i), p)), (order(i), p))
    out = Counter()
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < (order(i), p):
                gone[p : p + length] = b"\1" * length
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out[i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("length, gram, shard_bytes", [(100, 32, 32 << 20), (100, 32, 4000), (20, 8, 9000)])
def test_repeats(spark, length, gram, shard_bytes):
    rng = random.Random(3)
    pieces = ["".join(rng.choice("abcd ") for _ in range(rng.choice([20, 60, 99, 100, 101, 150, 400]))) for _ in range(40)]
    rows = []
    for i in range(150):
        text = "".join(rng.choice(pieces) if rng.random() < 0.6 else "".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(1, 120))) for _ in range(rng.randrange(0, 8)))
        at = rng.randrange(len(text) + 1)
        rows.append((i * 7, text[:at] + "é" + text[at:] if rng.random() < 0.3 else text))
    rows += [(1, "ab" * 300), (2, "a" * 1000), (3, "a" * (length - 1)), (4, "a" * length), (5, "abc" * 50 + "x" + "abc" * 50), (6, None), (8, ""), (None, pieces[6] * 2)]
    rows += [(9, "z" + pieces[5] * 3)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit(1), "keys": F.lit(2), "n_bytes": F.lit("x")}).repartition(5)
    found = suffix_dedup.remove_repeats(df, length=length, gram=gram, shard_bytes=shard_bytes, digests_only=True).collect()
    assert Counter(tuple(r) for r in found) == plain_repeats(rows, length)
    assert suffix_dedup.remove_repeats(df.limit(0)).collect() == []


def test_suffix_sort_survives_a_lying_hash(monkeypatch):
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (300, 40)).astype(np.uint8)
    sizes = rng.integers(0, 41, 300)
    rows[np.arange(40) >= sizes[:, None]] = 0
    group = np.sort(rng.integers(0, 9, 300))
    for lie in (False, True):
        if lie:
            monkeypatch.setattr(suffix_dedup.Suffixes, "lcp", lambda self, a, b: np.minimum(np.minimum(self.sizes[a], self.sizes[b]), 5))
        made = suffix_dedup.Suffixes(rows, sizes, group)
        expected = sorted(range(300), key=lambda i: (group[i], rows[i, : sizes[i]].tobytes()))
        text = lambda i: (group[i], rows[i, : sizes[i]].tobytes())
        assert [text(i) for i in made.order] == [text(i) for i in expected]


def test_entry_lists_the_queries():
    assert set(LLM_QUERIES) <= set(entry.queries()) and set(LLM_SQL) <= set(entry.oracle_sql())
    assert [sum(n.startswith(f"op{k}_") for n in LLM_QUERIES) for k in range(1, 11)] == [1] * 10 and "pipeline" in LLM_QUERIES


@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_queries_with_sql(name, spark, sf):
    assert oracle.compare(name, LLM_QUERIES[name], LLM_SQL[name], spark, oracle.connect(sf), sf) == ""


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    from prospectry.session import materialize

    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "stage")
        assert docs.count() <= rows and (docs.columns == columns or name == "bpe")
        rows = docs.count()
    assert 0 < rows
    texts = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [r.text for r in texts.join(docs.select("doc_id"), "doc_id").collect()]
    assert len(set(kept)) == len(kept) and not any(b in t for b in bench for t in kept)


def test_a_repeated_row_spreads_over_the_shards(spark):
    """A third of the rows are one row; shards stay exact, and the copies lie in all of them, whatever the partitions."""
    rows = [(i, f"t{i}") for i in range(400)] + [(7, "same")] * 200
    found = []
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        placed = sharding.shuffle_into_shards(df, shards=7, block_rows=50)
        found.append(sorted((r._shard, r._slot, r.doc_id, r.text) for r in placed.collect()))
    assert found[0] == found[1] and len(found[0]) == 600
    sizes = Counter(s for s, *_ in found[0])
    assert sorted(sizes.values()) == [85] * 2 + [86] * 5
    assert all([slot for s, slot, *_ in found[0] if s == k] == list(range(sizes[k])) for k in range(7))
    copies = Counter(s for s, _, _, t in found[0] if t == "same")
    assert len(copies) == 7 and min(copies.values()) > 10
