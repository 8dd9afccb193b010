"""The registered queries of this package, each over its whole table, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from prospectry.llm import bpe, decontaminate, exact_dedup, line_dedup, ngram_lm, ranked_search, sharding, simhash, spelling, suffix_dedup, toxicity, url_filter, window_dedup
from prospectry.llm.common import fold, table
from prospectry.session import materialize

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        LLM_QUERIES[name] = run
        if sql is not None:
            LLM_SQL[name] = sql
        return run

    return add


@query("op1_url_filter")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query(
    "op2_line_dedup",
    f"""
    WITH l AS (
        SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
        FROM documents
    ), wide AS (
        SELECT line FROM l WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY line HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}
    ), marked AS (SELECT l.*, wide.line IS NOT NULL AS gone FROM l LEFT JOIN wide USING (line))
    SELECT doc_id, count(*) AS n_lines, sum(gone::int)::bigint AS n_removed,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_decontaminate")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return sharding.shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0)
    model = toxicity.train(docs, labels)
    # Texts are scored once; thresholds and results both come from the written scores.
    scored = materialize(toxicity.score_texts(docs, model, lang_column="lang"), "toxicity-scores")
    model = toxicity.calibrate(scored, labels, model)
    threshold = toxicity.threshold_of(model, F.col("lang"))
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), threshold.alias("threshold"),
        (F.col("score") >= threshold).alias("flagged"),
    )


@query("op8_bpe_roundtrip")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(
    "op9_exact_dedup",
    """
    WITH n AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
    ), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), digests_only=True)


@query("op6_simhash_groups")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query("op10_lm_score")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, coded = ngram_lm.train(docs, fold("doc_id", 7) == 2, least=1)
    return ngram_lm.score_coded(coded, model).select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


_TERMS = r"""unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""


@query(
    "op11_ranked_search",
    f"""
    WITH t AS (
        SELECT rowid AS r, doc_id, {_TERMS}
        FROM (SELECT row_number() OVER () AS rowid, * FROM documents)
    ), d AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY r), s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
    q AS (
        SELECT item_id, term, count(*) AS times FROM (
            SELECT item_id, {_TERMS} FROM benchmark
        ) GROUP BY 1, 2
    ), f AS (SELECT r, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
    w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term),
    scored AS (
        SELECT q.item_id, d.doc_id, d.r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * d.n * s.docs) // s.terms))))::BIGINT AS score
        FROM q JOIN f USING (term) JOIN w USING (term) JOIN d USING (r), s GROUP BY ALL
    )
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 10
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query(
    "op13_window_dedup",
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
    ), w AS (SELECT r, doc_id, k, words[k : k + 12] AS win FROM (SELECT *, unnest(range(1, len(words) - 11)) AS k FROM d)),
    f AS (SELECT *, min(doc_id) OVER (PARTITION BY win) AS first FROM w),
    gone AS (SELECT DISTINCT r, k + o AS k FROM f, range(13) AS t(o) WHERE first < doc_id),
    x AS (
        SELECT d.r, count(*) AS n_removed, list(gone.k) AS ks FROM d JOIN gone USING (r) GROUP BY d.r
    ), e AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM d),
    kept AS (SELECT e.r, string_agg(word, ' ' ORDER BY e.k) AS kept FROM e ANTI JOIN gone USING (r, k) GROUP BY e.r)
    SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN x USING (r) LEFT JOIN kept USING (r)
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.remove_windows(table(spark, sf_dir, "documents"), digests_only=True)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
