"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed rows: one for the word and one for each of its first letters, so
that unseen forms of a seen stem are known. Filters of several widths run over the words of the whole text, each
filter keeps its greatest value (max pooling), and a logistic layer gives the score. Rows start from smoothed
log-odds of the labels and are trained together with the filters by Adagrad; the gradient only passes through
the windows that won the pooling. Part of the sample is kept aside to fit a scale and an offset of the score; the decision
thresholds, one for each language, come from all labelled rows that the fit has not seen.
"""

from __future__ import annotations

import pickle
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectry.llm.common import arrow_schema, bound_batches, forget
from prospectry.session import materialize

#: Bound of the training sample, in labelled documents.
SAMPLE = 12_000
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 12
#: First letters that give a word's further rows.
STEMS = (4, 5, 6)
#: Words of a piece of text that is pooled at once, and words that a worker remembers; speed and memory only.
PIECE, REMEMBERED = 1 << 15, 300_000
PARTS = 1 + len(STEMS)
#: Steps of the score within which rows are counted together when thresholds are chosen, and toxic rows that a threshold needs.
STEPS, LEAST_TOXIC = 10_000, 10


def word_rows(word: str) -> tuple[int, ...]:
    """Buckets of one word and of its stems."""
    bare = word.strip(string.punctuation) or word
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in (bare, *[f"{n}^{bare[:n]}" for n in STEMS]))


@dataclass
class Model:
    rows: np.ndarray
    filters: list[np.ndarray]
    shifts: list[np.ndarray]
    weights: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def limit(self, lang: str | None) -> float:
        """Score from which a text of this language counts as toxic."""
        return self.thresholds.get(lang or "", self.threshold)

    def pooled(self, words: np.ndarray, ends: np.ndarray, winners: bool = False):
        """Pooled filter values of documents that lie one after another in ``words`` (n x DIM).

        Each document has at least one word. With ``winners``, also the place of the winning window of each.
        """
        starts = np.concatenate([[0], ends[:-1]])
        gap = max(WIDTHS) - 1
        n = len(ends)
        spread = np.zeros((len(words) + gap * n, DIM), np.float32)
        spread[np.arange(len(words)) + gap * np.repeat(np.arange(n), ends - starts)] = words
        first = starts + gap * np.arange(n)
        bounds = np.stack([first, first + ends - starts], 1).ravel()
        values, places = [], []
        for width, w, shift in zip(WIDTHS, self.filters, self.shifts):
            m = len(spread) - gap
            out = np.zeros((len(spread), FILTERS), np.float32)
            for k in range(width):
                out[:m] += spread[k : m + k] @ w[k]
            best = np.maximum.reduceat(out, np.minimum(bounds, len(out) - 1), axis=0)[::2]
            if winners:
                places.append(np.stack([a + out[a:b].argmax(axis=0) for a, b in bounds.reshape(-1, 2)]))
            values.append(np.maximum(best + shift, 0))
        return (np.concatenate(values, 1), places, spread, first) if winners else np.concatenate(values, 1)

    def score(self, pooled: np.ndarray) -> np.ndarray:
        logit = self.scale * (pooled @ self.weights + self.bias) + self.offset
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30).astype(np.float64)))


def _train(docs: list[np.ndarray], labels: np.ndarray, epochs: int, seed: int) -> Model:
    """Fit on documents given as (words x PARTS) buckets."""
    rng = np.random.default_rng(seed)
    prior = (labels.sum() + 1) / (len(labels) + 2)
    seen, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for doc, label in zip(docs, labels):
        of_doc = np.unique(doc)
        seen[of_doc] += 1
        toxic[of_doc] += label
    rate = (toxic + 4 * prior) / (seen + 4)
    odds = np.where(seen >= 3, np.log(rate / (1 - rate)) - np.log(prior / (1 - prior)), 0)
    rows = (rng.normal(size=(BUCKETS, DIM)) * 0.02 * (seen >= 3)[:, None]).astype(np.float32)
    rows[:, 0] = odds / PARTS
    filters = [(rng.normal(size=(w, DIM, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS]
    for w in filters:
        w[:, 0] += 0.3
    model = Model(rows, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.1, np.float32), float(np.log(prior / (1 - prior))))
    squares = [np.full_like(x, 1e-2) for x in (model.rows, *model.filters, *model.shifts, model.weights)]

    def step(x: np.ndarray, at: int, grad: np.ndarray, rate: float, index=slice(None)) -> None:
        squares[at][index] += grad * grad
        x[index] -= rate * grad / np.sqrt(squares[at][index])

    order = np.arange(len(docs))
    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            parts = np.concatenate([docs[i] for i in batch])
            ends = np.cumsum([len(docs[i]) for i in batch])
            pooled, places, spread, first = model.pooled(model.rows[parts].sum(1), ends, winners=True)
            logit = pooled @ model.weights + model.bias
            error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[batch]) / len(batch)).astype(np.float32)
            back = error[:, None] * model.weights * (pooled > 0)
            step(model.weights, len(squares) - 1, pooled.T @ error + 1e-4 * model.weights, 0.05)
            model.bias -= 0.05 * float(error.sum())
            touched, pushed = [], []
            # spread has gaps between documents; owner gives the word of a place, or -1
            owner = np.full(len(spread) + max(WIDTHS), -1)
            starts = np.concatenate([[0], ends[:-1]])
            owner[np.arange(len(parts)) + np.repeat(first - starts, ends - starts)] = np.arange(len(parts))
            for k, (width, w, shift) in enumerate(zip(WIDTHS, model.filters, model.shifts)):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                grad = np.zeros_like(w)
                for j in range(width):
                    where = np.minimum(places[k] + j, len(spread) - 1)
                    grad[j] = np.einsum("df,dfe->ef", g, spread[where])
                    word = owner[where].ravel()
                    real = (word >= 0) & (g.ravel() != 0)
                    touched.append(word[real])
                    pushed.append((g[:, :, None] * w[j].T[None]).reshape(-1, DIM)[real])
                step(w, 1 + k, grad, 0.02)
                step(shift, 1 + len(WIDTHS) + k, g.sum(0), 0.02)
            word, push = np.concatenate(touched), np.concatenate(pushed)
            bucket, place = np.unique(parts[word].ravel(), return_inverse=True)
            grad = np.zeros((len(bucket), DIM), np.float32)
            np.add.at(grad, place.ravel(), np.repeat(push, PARTS, axis=0))
            known = seen[bucket] >= 3
            step(model.rows, 0, grad[known], 0.02, bucket[known])
    return model


def _calibrate(model: Model, logits: np.ndarray, labels: np.ndarray, langs: list[str]) -> None:
    """Scale and offset by Newton steps on the logistic loss, then the thresholds of greatest F1."""
    a, b = 1.0, 0.0
    if 0 < labels.sum() < len(labels):
        soft = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / (len(labels) - labels.sum() + 2))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
            g = np.array([((p - soft) * logits).sum() + 1e-2 * (a - 1), (p - soft).sum()])
            v = p * (1 - p) + 1e-9
            h = np.array([[(v * logits**2).sum() + 1e-2, (v * logits).sum()], [(v * logits).sum(), v.sum() + 1e-6]])
            move = np.clip(np.linalg.solve(h, g), -1, 1)
            a, b = max(0.05, a - move[0]), b - move[1]
    model.scale, model.offset = float(a), float(b)
    scores = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))

    def best(s: np.ndarray, y: np.ndarray) -> float:
        """Middle of the gap below the lowest accepted score of the greatest F1."""
        order = np.argsort(-s, kind="stable")
        hit = np.cumsum(y[order])
        f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
        k = int(f1.argmax())
        low = s[order[k + 1]] if k + 1 < len(s) else 0.0
        return float((s[order[k]] + low) / 2)

    model.threshold = best(scores, labels) if labels.sum() >= LEAST_TOXIC else 0.5
    of = np.array(langs)
    for lang in sorted(set(langs)):
        here = of == lang
        if labels[here].sum() >= LEAST_TOXIC:
            model.thresholds[lang] = best(scores[here], labels[here])


def _buckets(text: str, known: dict[str, tuple[int, ...]]) -> np.ndarray:
    out = []
    for word in text.lower().split():
        rows = known.get(word)
        if rows is None:
            if len(known) >= REMEMBERED:
                known.clear()
            rows = known[word] = word_rows(word)
        out.append(rows)
    return np.array(out or [word_rows("")], np.int32)


def _labelled(labels: DataFrame, id_column: str, label_column: str) -> DataFrame:
    """(_id, _label) of the documents with a usable label."""
    return (
        labels.filter(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).cast("long").alias("_id")).agg(F.max(label_column).cast("int").alias("_label"))
    )


def _aside(doc_id: int) -> bool:
    """Whether a document of the sample is kept from fitting, for calibration."""
    return zlib.crc32(f"aside {doc_id}".encode()) % 5 == 0


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
    label_column: str = "toxic", sample: int = SAMPLE, epochs: int = 4, seed: int = 7,
) -> Model:
    """Fit on at most ``sample`` labelled documents, the first by the hash of their id; runs as one Spark task.

    Rows whose label is neither 0 nor 1, or that have no id, are not used; of several labels of one document
    the greatest counts. Without any labelled document the model scores everything as not toxic.
    """
    chosen = _labelled(labels, id_column, label_column).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # At most ``sample`` rows of two numbers: small whatever the input.
    named = docs.select(
        F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(lang_column).cast("string"), F.lit("")).alias("lang"), F.col(text_column).cast("string").alias("text")
    )
    rows = named.join(F.broadcast(chosen), F.col("id") == F.col("_id")).select("id", F.col("_label").alias("label"), "lang", "text")
    # One text for an id, the same one in every run, so the sample is bounded in rows as well as in ids.
    one = rows.groupBy("id").agg(F.min(F.xxhash64("text")).alias("_one"))
    rows = rows.join(F.broadcast(one), "id").filter(F.xxhash64("text") == F.col("_one")).dropDuplicates(["id"]).select("id", "label", "lang", "text")
    schema, ddl = arrow_schema(id="long", label="int", lang="string", parts="binary")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            parts = [_buckets(t.as_py() or "", known).tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(parts, pa.binary())], schema=schema)

    model_schema, model_ddl = arrow_schema(model="binary")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        rows.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"], len(r["parts"])))
        docs = [np.frombuffer(r["parts"], np.int32).reshape(-1, PARTS) for r in rows]
        y = np.array([r["label"] for r in rows], np.float32)
        aside = np.array([_aside(r["id"]) for r in rows], bool)
        fitting = np.flatnonzero(~aside)
        if not len(fitting):
            model = _train([np.array([word_rows("")], np.int32)], np.zeros(1, np.float32), 0, seed)
        else:
            model = _train([docs[i] for i in fitting], y[fitting], epochs, seed)
        held = np.flatnonzero(aside)
        if len(held):
            pooled = np.concatenate([model.pooled(model.rows[docs[i]].sum(1), np.array([len(docs[i])])) for i in held])
            _calibrate(model, (pooled @ model.weights + model.bias).astype(float), y[held].astype(float), [rows[i]["lang"] for i in held])
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(model), 1)], pa.binary())], schema=model_schema)

    bound_batches(docs.sparkSession)
    # One task: the sample is bounded, and its texts are hashed in parallel before.
    found = rows.mapInArrow(hashed, ddl).repartition(1).mapInArrow(fit, model_ddl).first()
    return pickle.loads(zlib.decompress(found["model"]))




def calibrate(
    scored: DataFrame, labels: DataFrame, model: Model, id_column: str = "doc_id", label_column: str = "toxic", sample: int = SAMPLE,
) -> Model:
    """The model with thresholds of greatest F1, common and by language, over all labelled rows that were not fitted on.

    ``scored`` has (doc_id, lang, score) of all documents, as :func:`score_texts` gives them, so that no text is moved to
    meet its label. Rows are counted by language and step of the score; every language is judged from its
    counts. ``sample`` is that of :func:`train`. Languages with fewer than LEAST_TOXIC toxic rows use the common
    threshold; with fewer in all, thresholds stay as they were: 0.5 after a fit that had as few.
    """
    known = _labelled(labels, id_column, label_column)
    aside = F.crc32(F.concat(F.lit("aside "), F.col("_id").cast("string")).cast("binary")) % 5 == 0
    fitted = known.orderBy(F.xxhash64("_id"), "_id").limit(sample).filter(~aside).select("_id")
    unseen = known.join(F.broadcast(fitted), "_id", "left_anti")  # at most ``sample`` numbers
    rows = scored.select(F.col("doc_id").alias("_id"), F.coalesce("lang", F.lit("")).alias("lang"), "score").join(unseen, "_id").withColumnRenamed("_label", "label")
    step = F.floor(F.col("score") * STEPS)
    counted = rows.groupBy("lang", step.alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic"), F.min("score").alias("low"), F.max("score").alias("high")
    )
    counted = materialize(counted, "toxicity-counts")

    def judge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("step", ascending=False)
        toxic = int(part["toxic"].sum())
        f1 = 2 * part["toxic"].cumsum().to_numpy() / (part["n"].cumsum().to_numpy() + max(1, toxic))
        k = int(f1.argmax())
        below = part["high"].iloc[k + 1] if k + 1 < len(part) else 0.0
        return pd.DataFrame({"lang": part["lang"].iloc[:1], "toxic": [toxic], "threshold": [(part["low"].iloc[k] + below) / 2]})

    kinds = "lang string, toxic long, threshold double"
    whole = counted.groupBy("step").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.min("low").alias("low"), F.max("high").alias("high"))
    common = whole.withColumn("lang", F.lit("")).groupBy("lang").applyInPandas(judge, kinds).first()
    own = counted.groupBy("lang").applyInPandas(judge, kinds).filter(F.col("toxic") >= LEAST_TOXIC).collect()  # one row for each language
    return replace(
        model, threshold=float(common["threshold"]) if common and common["toxic"] >= LEAST_TOXIC else model.threshold,
        thresholds={r["lang"]: float(r["threshold"]) for r in own} or model.thresholds,
    )


class Scorer:
    """A worker's copy of the model with the embeddings of the words it met last."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.table = np.zeros((1 << 12, DIM), np.float32)
        self.table[0] = self.model.rows[list(word_rows(""))].sum(0)

    def _ids(self, words: list[str]) -> np.ndarray:
        index = self.index
        new = list({w for w in words if w not in index})
        if new:
            if len(index) + len(new) > REMEMBERED:
                self.forget()
                index, new = self.index, list(set(words) - {""})
            at = len(index)
            while at + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at : at + len(new)] = self.model.rows[np.array([word_rows(w) for w in new])].sum(1)
            index.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def score(self, texts: list[str]) -> np.ndarray:
        pooled = np.zeros((len(texts), FILTERS * len(WIDTHS)), np.float32)
        held: list[tuple[int, list[str]]] = []

        def flush() -> None:
            if held:
                ids = self._ids([w for _, words in held for w in words])
                values = self.model.pooled(self.table[ids], np.cumsum([len(words) for _, words in held]))
                np.maximum.at(pooled, [d for d, _ in held], values)
                held.clear()

        size = 0
        for d, text in enumerate(texts):
            words = text.lower().split() or [""]
            # Long texts are pooled in pieces that overlap by the widest window; the greatest value is the same.
            for at in range(0, len(words), PIECE):
                piece = words[at : at + PIECE + max(WIDTHS) - 1]
                held.append((d, piece))
                size += len(piece)
                if size >= PIECE:
                    flush()
                    size = 0
        flush()
        return self.model.score(pooled)


def score_texts(df: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", lang_column: str | None = None) -> DataFrame:
    """(doc_id, score) of each row, a narrow step. Null and empty texts get the score of a text without words.

    With ``lang_column``, also the row's language, which has no part in the score.
    """
    named = [F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")]
    kinds = {"doc_id": "long", "score": "double"} | ({"lang": "string"} if lang_column else {})
    schema, ddl = arrow_schema(**kinds)
    shared = df.sparkSession.sparkContext.broadcast(model)  # size fixed by BUCKETS and DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = scorer.score([t.as_py() or "" for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), *batch.columns[2:]], schema=schema)

    bound_batches(df.sparkSession)
    return df.select(*named, *([F.col(lang_column).cast("string").alias("lang")] if lang_column else [])).mapInArrow(run, ddl)


def threshold_of(model: Model, lang: Column) -> Column:
    """The threshold of a row's language."""
    known = [F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair]
    own = F.try_element_at(F.create_map(*known), F.coalesce(lang, F.lit(""))) if known else F.lit(None).cast("double")
    return F.coalesce(own, F.lit(model.threshold))


def reject_toxic(df: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows of ``df``, all columns, whose score stays below the threshold of their language.

    Languages without a calibrated threshold, null included, use the common one. All columns pass through
    one narrow step; nothing is shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            names = batch.schema.names
            scores = scorer.score([t.as_py() or "" for t in batch.column(names.index(text_column)).cast(pa.string())])
            langs = batch.column(names.index(lang_column)).cast(pa.string()).to_pylist()
            limits = np.array([scorer.model.limit(x) for x in langs])
            yield batch.filter(pa.array(scores < limits))

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)
