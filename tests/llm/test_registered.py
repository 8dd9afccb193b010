"""Every registered query over whole small tables, against plain versions where there is one."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prospectry.llm import decontaminate
from prospectry.llm.queries import LLM_QUERIES, LLM_SQL


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def run(spark, sf, name):
    return LLM_QUERIES[name](spark, sf).collect()


def test_names():
    assert [n for n in LLM_QUERIES if n != "pipeline"] and {int(n[2:].split("_")[0]) for n in LLM_QUERIES if n != "pipeline"} == set(range(1, 14))
    assert {"op2_line_dedup", "op9_exact_dedup", "op11_ranked_search", "op13_window_dedup"} <= set(LLM_SQL)


def test_url_filter(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    rules = [("com", "/", "allow", "com/"), ("example.com", "/en/", "block", "example.com/en/"), ("www.example.com", "/en/", "allow", "www.example.com/en/"), ("net", "/es/", "block", "net/es/"), ("net", "/fr/", "block", "net/fr/")]
    found = {r.page_id: r for r in run(spark, sf, "op1_url_filter")}
    assert len(found) == len(pages)
    for page_id, url in pages:
        host, path = "", ""
        if url and "://" in url:
            host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(h, p, v, name) for h, p, v, name in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda x: len(x[3]), default=None)
        r = found[page_id]
        assert (r.host, r.path, r.rule) == (host, path, best and best[3])
        assert r.verdict == best[2] if best else r.verdict in ("allow", "block")


def test_decontamination_finds_what_exhaustive_search_finds(spark, sf, docs):
    items = {r.item_id: decontaminate.words_of(r.text.encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text}
    found = {(r.doc_id, r.item_id) for r in run(spark, sf, "op3_decontaminate")}
    split = {i: decontaminate.words_of(t.encode()) for i, t in docs.items()}
    expected = set()
    for item_id, words in items.items():
        bits, known = decontaminate.places(words), set(words)
        for doc_id, text in split.items():
            # Only documents with half of the item's words can hold half of them in sequence.
            if len(known.intersection(text)) * 2 >= len(known) and decontaminate._best_share(bits, len(words), text) >= decontaminate.SAME:
                expected.add((doc_id, item_id))
    assert expected and len(found & expected) >= 0.9 * len(expected)


def test_sharding(spark, sf, docs):
    rows = run(spark, sf, "op4_sharding")
    assert Counter((r.doc_id, r.text_crc32, r.size) for r in rows) == Counter((i, zlib.crc32(t.encode()), len(t.encode()) + 8) for i, t in docs.items())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and set(slots) == set(range(24))


def test_suffix_dedup(spark, sf, docs):
    first, expected = {}, {}
    for i in sorted(docs):
        text = docs[i].encode()
        gone = np.zeros(len(text), bool)
        for k in range(len(text) - 99):
            if first.setdefault(text[k : k + 100], (i, k)) != (i, k):
                gone[k : k + 100] = True
        spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        expected[i] = len(text), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, sf, "op5_suffix_dedup")} == expected


def test_simhash_groups(spark, sf, docs):
    prints = {}
    for i, t in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        some = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        ones = sum(np.array([xxhash.xxh64_intdigest(s, 42) >> b & 1 for b in range(64)]) for s in some) if some else np.zeros(64)
        prints[i] = sum(1 << b for b in range(64) if ones[b] * 2 > len(some))
    root = {i: i for i in docs}
    for i in docs:
        for j in docs:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, sf, "op6_simhash_groups")} == {i: (f"{prints[i]:016x}", root[i]) for i in docs}


def test_toxicity(spark, sf):
    sf = sf.replace("0.001", "0.01")  # enough labels to tell held-out accuracy
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic IS NOT NULL").collect()}
    rows = run(spark, sf, "op7_toxicity")
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.flagged == (r.score >= r.threshold) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    assert len(held) > 20 and sum(p == y for p, y in held) >= 0.9 * len(held)


def test_bpe_equals_the_library(spark, sf, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    for r in run(spark, sf, "op8_bpe_roundtrip"):
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pipeline(spark, sf, docs):
    rows = run(spark, sf, "pipeline")
    ids = [r.doc_id for r in rows]
    assert len(set(ids)) == len(ids) and set(ids) < set(docs) and len(ids) > len(docs) // 2
    held = {(r.doc_id) for r in LLM_QUERIES["op3_decontaminate"](spark, sf).select("doc_id").distinct().collect()}
    assert not held & set(ids)
    kept = [docs[i] for i in ids]
    assert len({t.lower() for t in kept}) == len(kept)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    one = max(rows, key=lambda r: r.doc_id)
    assert one.ids == library.encode(docs[one.doc_id], add_special_tokens=False).ids
