"""From documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prospectry.llm import bpe, decontaminate, exact_dedup, near_copies, toxicity
from prospectry.llm.common import fold, table
from prospectry.session import materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold of their language; model and thresholds come from the training fold of ``labels``."""
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0)
    model = toxicity.train(docs, labels)
    model = toxicity.calibrate(toxicity.score_texts(docs, model, lang_column="lang"), labels, model)
    return toxicity.reject_toxic(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 over 5-word shingles, the one with the smallest doc_id.

    Candidates come from the SimHash index, and from rare-first prefixes of the shingles where fingerprints lie too far apart for it.
    """
    return near_copies.drop_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and decoded text of each document."""
    return bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("bpe", tokens_stage),
]

#: The classifier's and the retrieval's decisions have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
