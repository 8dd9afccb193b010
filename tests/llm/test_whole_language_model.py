"""The registered language model counts every pair and triple of its training texts."""

import math
import random
import zlib
from collections import Counter

import pytest

from prospectry.llm import ngram_lm
from prospectry.llm.queries import LLM_QUERIES


@pytest.mark.parametrize("small", [False, True])
def test_query_scores_by_all_counts(spark, monkeypatch, tmp_path, small):
    if small:  # many shards
        monkeypatch.setattr(ngram_lm, "SHARD_BYTES", 3000)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(120)]
    once = "these words stand here only once"
    inside = next(i for i in range(500, 600) if zlib.crc32(str(i).encode()) % 7 != 2)
    held = next(i for i in range(600, 700) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows += [(inside, once), (held, once)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in LLM_QUERIES["op10_lm_score"](spark, str(tmp_path)).collect()}

    tokens = {i: [*t.encode().split(), b""] for i, t in rows}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two, three = (Counter(g for t in train for g in zip(*(t[k:] for k in range(n)))) for n in (1, 2, 3))
    n, v, d = sum(one.values()), len(one), ngram_lm.DISCOUNT
    kinds2, kinds3, sums2, sums3 = Counter(k[:1] for k in two), Counter(k[:2] for k in three), Counter(), Counter()
    for k, c in two.items():
        sums2[k[:1]] += c
    for k, c in three.items():
        sums3[k[:2]] += c
    p1 = lambda w: (one[w,] + 1) / (n + v + 1)

    def p2(a, w):
        if not one[a,]:
            return p1(w)
        return max(two[a, w] - d, 0) / one[a,] + (1 - (sums2[a,] - d * kinds2[a,]) / one[a,]) * p1(w)

    def p3(a, b, w):
        if not two[a, b]:
            return p2(b, w)
        return max(three[a, b, w] - d, 0) / two[a, b] + (1 - (sums3[a, b] - d * kinds3[a, b]) / two[a, b]) * p2(b, w)

    assert len(found) == len(rows)
    for i, t in tokens.items():
        score = sum(math.log10(p1(w) if k == 0 else p2(t[0], w) if k == 1 else p3(t[k - 2], t[k - 1], w)) for k, w in enumerate(t))
        assert abs(found[i].score - score) < 0.04 * len(t), i
