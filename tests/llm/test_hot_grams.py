"""Suffix dedup where one gram has many different surroundings."""

import random
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from test_table_operators import plain_repeats

from prospectry.llm import suffix_dedup


def made_rows():
    rng = random.Random(8)
    line = "one line that stands in very many texts with other bytes around it"
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 300))) + line + "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 300))) for _ in range(90)]
    texts += [rng.choice(texts)[rng.randrange(60) :] + rng.choice(texts)[: rng.randrange(300)] for _ in range(60)]
    return [*enumerate(texts), (1000, "ab" * 300), (1001, None), (None, texts[3]), (1002, line * 5), (1003, texts[4]), (1003, texts[4])]


@pytest.mark.parametrize("hot, shard_bytes", [(3, 32 << 20), (3, 4000), (0, 9000)])
def test_hot_grams_give_the_same(spark, hot, shard_bytes):
    rows = made_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = suffix_dedup.remove_repeats(df, shard_bytes=shard_bytes, digests_only=True, hot=hot).collect()
    assert Counter(tuple(r) for r in found) == plain_repeats(rows, 100)


def test_no_group_is_larger_than_the_bound(monkeypatch, tmp_path):
    setup = suffix_dedup.Setup(str(tmp_path), 1, 100, 32, 10)
    rows = [r for r in made_rows() if r[0] is not None]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows], pa.string())], names=["doc_id", "text"])
    largest, plain = [], suffix_dedup.windows_seen

    def watched(bytes_, left, right, group, rank, setup):
        largest.append(max(Counter(group.tolist()).values()))
        return plain(bytes_, left, right, group, rank, setup)

    monkeypatch.setattr(suffix_dedup, "windows_seen", watched)
    for step in (suffix_dedup._count_grams, suffix_dedup._send_contexts):
        run, _, gather = step(setup)
        sent = pd.concat([b.to_pandas() for b in run(iter([batch]))])
        for _, own in sent.groupby("shard"):
            gather(own)
    assert 0 < max(largest) <= 10 and (tmp_path / "windows-0").exists()
