"""Verdict queries: events as the ratings log, customers as merged rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectry.catalog import standins as st
from prospectry.catalog.registry import query
from prospectry.operators import evaluations as ev

_ROWS = f"WITH v AS ({st.VERDICTS_SQL}), p AS ({st.PARENT_SQL})"
_KEYED = "trim(coalesce(listing_link, '')) <> ''"
_LATEST = f"""{_ROWS}, r AS (SELECT trim(listing_link) AS link, seq, eval_rating, eval_time, notes,
    row_number() OVER (PARTITION BY trim(listing_link) ORDER BY seq DESC) AS rn FROM v WHERE {_KEYED}),
    latest AS (SELECT link, seq, eval_rating, eval_time, notes FROM r WHERE rn = 1)"""
_LOG = ["listing_link", "seq", "eval_rating", "eval_time", "notes"]


def latest(spark, d):
    return ev.latest_evaluation(st.verdicts(spark, d).select(*_LOG), ["seq"])


@query("latest_evaluation", f"{_LATEST} SELECT * FROM latest")
def latest_evaluation(spark, d):
    return latest(spark, d)


@query(
    "attach_latest_eval",
    f"""{_LATEST} SELECT file_idx, row_idx, listing_link, name, status,
        coalesce(nullif(lower(trim(eval_rating)), ''), lower(trim(status))) AS rating_tag, coalesce(notes, '') AS notes
    FROM p LEFT JOIN latest ON trim(p.listing_link) = latest.link""",
)
def attach_latest_eval(spark, d):
    return ev.attach_latest_evaluation(st.merged_parent(spark, d), latest(spark, d))


@query(
    "apply_eval_to_parent",
    f"""{_ROWS}, k AS (SELECT file_idx, trim(listing_link) AS link, row_idx, seq, eval_rating,
            {_KEYED} AND EXISTS (SELECT 1 FROM p WHERE p.file_idx = v.file_idx AND trim(p.listing_link) = trim(v.listing_link)) AS by_link FROM v),
    hits AS (
        SELECT p.file_idx, p.row_idx, k.seq, k.eval_rating FROM k JOIN p ON k.by_link AND p.file_idx = k.file_idx AND trim(p.listing_link) = k.link
        UNION ALL
        SELECT file_idx, row_idx, seq, eval_rating FROM k WHERE NOT coalesce(by_link, false)),
    won AS (SELECT file_idx, row_idx, arg_max(eval_rating, seq) AS rating FROM hits GROUP BY file_idx, row_idx)
    SELECT p.file_idx, p.row_idx, p.listing_link, p.name, coalesce(won.rating, p.status) AS status
    FROM p LEFT JOIN won ON p.file_idx = won.file_idx AND p.row_idx = won.row_idx""",
)
def apply_eval_to_parent(spark, d):
    verdicts = st.verdicts(spark, d).withColumnRenamed("eval_rating", "rating")
    return ev.apply_evaluations(st.merged_parent(spark, d), verdicts)


@query(
    "evaluation_rows",
    f"""{_ROWS} SELECT row_idx, name, 'good' AS eval_rating, date_trunc('second', o.o_orderdate) AS eval_time, trim(' ok ') AS notes
    FROM p JOIN orders o ON p.row_idx = o.o_orderkey""",
)
def evaluation_rows(spark, d):
    seen = st.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_idx"), "o_orderdate")
    rows = st.merged_parent(spark, d).select("row_idx", "name").join(seen, "row_idx")
    return ev.evaluation_rows(rows, F.lit("good"), F.col("o_orderdate"), F.lit(" ok\n")).drop("o_orderdate")


@query(
    "union_evaluations",
    f"""{_ROWS} SELECT listing_link, eval_rating, notes, CAST(NULL AS STRING) AS name FROM v
    UNION ALL SELECT listing_link, 'okay', NULL, name FROM p""",
)
def union_evaluations(spark, d):
    old = st.verdicts(spark, d).select("listing_link", "eval_rating", "notes")
    new = st.merged_parent(spark, d).select("name", "listing_link", F.lit("okay").alias("eval_rating"))
    return ev.union_evaluations(old, new)


@query("filter_by_status", f"{_ROWS} SELECT row_idx, status FROM p WHERE lower(trim(status)) = 'good'")
def filter_by_status(spark, d):
    return ev.filter_by_status(st.merged_parent(spark, d), " Good").select("row_idx", "status")
