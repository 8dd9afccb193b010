"""What lets the model grow: few steps for a look-up, words split in bulk, no shuffle files left behind."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from prospectry.llm import ngram_lm
from prospectry.llm.elias_fano import EliasFano


def test_dense_stretches_take_few_steps(monkeypatch):
    """A common word's successors lie dense beside sparse ones; a value among them is found in few steps, not in all halvings."""
    rng = np.random.default_rng(5)
    dense = np.unique(rng.integers(0, 1 << 22, 60_000))
    values = np.concatenate([dense, (1 << 22) + np.unique(rng.integers(0, 1 << 34, 40_000))])
    coded = EliasFano.of(values)
    places, looked, low = rng.permutation(len(values)), [], EliasFano._low
    monkeypatch.setattr(EliasFano, "_low", lambda self, i: looked.append(len(i)) or low(self, i))
    assert (coded.find(values[places]) == places).all()
    assert sum(looked) < 6 * len(values)
    others = np.setdiff1d(rng.integers(0, 1 << 34, 5000), values)
    assert (coded.find(others) == -1).all()


def test_steps_are_bounded_where_values_lie_unevenly():
    values = np.cumsum(np.concatenate([np.ones(3000, np.int64), 1 << (np.arange(3000) % 40)]))
    coded = EliasFano.of(values)
    assert (coded.find(values) == np.arange(len(values))).all()
    assert (coded.find(np.setdiff1d(values + 1, values)) == -1).all()


def test_neighbours():
    rng = np.random.default_rng(6)
    values = np.sort(rng.integers(0, 5000, 3000))  # equal values, full words of ones and empty ones
    values = np.concatenate([values, values[-1] + 1 + np.sort(rng.integers(0, 1 << 30, 50))])
    coded = EliasFano.of(values)
    at = rng.permutation(len(values) - 1)
    one, after = coded.neighbours(at)
    assert (one == values[at]).all() and (after == values[at + 1]).all()


def test_words_of_a_column():
    texts = ["", " a  b\n", None, "x\x00Y\x1cz", "É é\x0bq\x0c\r\tW w", "   ", "a"]
    column = pa.array(["skipped", *texts], pa.string()).slice(1)
    number, distinct, counts = ngram_lm.split_words(column)
    ends = np.cumsum(counts)
    found = [[distinct[k] for k in number[e - n : e]] for e, n in zip(ends, counts)]
    assert found == [ngram_lm.words_of((t or "").encode())[:-1] for t in texts]
    assert [len(x) for x in ngram_lm.split_words(column.slice(0, 0))] == [0, 0, 0]


def test_squeezed_numbers():
    for values in ([], [0], [1, 255], [256, 3, 3], [70_000], [1 << 40]):
        assert ngram_lm.widen(ngram_lm.squeeze(np.array(values, np.int64))).tolist() == values


def test_training_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in (str(disk.getAllFiles().apply(i)) for i in range(disk.getAllFiles().size())) if "/shuffle_" in f}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key), shuffles()
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("same words "), F.col("id") % 50, F.lit(" and others")).alias("text")).repartition(3)
    model, _ = ngram_lm.train(docs, F.col("doc_id") % 7 == 2)
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before and model.tokens > 1000 and spark.conf.get(key) == setting


def test_shards_are_not_built_by_one_task(spark, tmp_path):
    """Steps over all shards deal them out, however short their rows are."""

    def note(shard):
        from pyspark import TaskContext

        (tmp_path / f"{shard}-{TaskContext.get().partitionId()}").touch()

    ngram_lm._each_shard(spark, 6, note)
    assert len({p.name.split("-")[1] for p in tmp_path.iterdir()}) == len(list(tmp_path.iterdir())) == 6
