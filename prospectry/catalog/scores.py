"""Score queries: one scored business per lineitem row, and the site profile scored."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectry.catalog import standins as st
from prospectry.catalog.registry import query
from prospectry.catalog.site_signals import PROFILE_SQL, scored_profile
from prospectry.operators import scoring

AS_OF_YEAR = 2026

# Metrics as expressions of the row; every rule is met and missed, and some metrics are unknown.
METRICS = {
    "attributes": "CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN -1 ELSE CAST(l_suppkey % 7 AS INT) END",
    "gbp_has_image": "CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey % 4 < 3 END",
    "n_categories": "CAST(l_partkey % 3 AS INT)",
    "verified": "CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END",
    "has_phone": "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_orderkey % 5 > 1 END",
    "phone_plus": "l_orderkey % 2 = 0",
    "has_address": "l_orderkey % 3 > 0",
    "listed": "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_orderkey % 4 AS INT) END",
    "has_website": "CASE WHEN l_suppkey % 9 = 0 THEN false WHEN l_suppkey % 9 = 1 THEN NULL ELSE true END",
    "ssl_bad": "CASE l_suppkey % 6 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END",
    "http_allowed": "l_suppkey % 5 < 3",
    "to_https": "CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END",
    "responsive": "CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END",
    "builders": "CASE l_partkey % 8 WHEN 0 THEN 'Squarespace,Webflow,Wix' WHEN 1 THEN 'Carrd' WHEN 2 THEN NULL ELSE 'Unknown' END",
    "favicon": "l_partkey % 7 <> 3", "html5": "l_partkey % 9 <> 4", "generic": "l_partkey % 11 = 5",
    "described": "l_partkey % 10 <> 6", "h1": "l_orderkey % 6 <> 1", "analytics": "CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_orderkey % 4 > 1 END",
    "words": "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS INT) * 5 END",
    "images": "CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_linenumber AS INT) - 1 END",
    "latest_year": "CASE WHEN l_orderkey % 8 = 0 THEN NULL ELSE CAST(2010 + l_orderkey % 29 AS INT) END",
    "sitemap_found": "CASE l_suppkey % 3 WHEN 0 THEN NULL ELSE 'https://x/sitemap.xml' END",
    "pages": "CAST(l_partkey % 12 AS INT)",
    "framework": "CASE l_suppkey % 5 WHEN 0 THEN 'Vue,Astro' WHEN 1 THEN 'Next.js' ELSE 'Unknown' END",
    "uses_js": "CASE l_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END",
    "jquery": "l_partkey % 2 = 0",
    "seconds": "CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(CAST(l_quantity AS INT) % 29 AS DOUBLE) / 2 + 0.125 END",
}
_KEYS = {
    n: n for n in (
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"
    )
}
_ROWS = f"WITH m AS ({st.as_sql('lineitem', {**_KEYS, **METRICS})})"

# (place, condition, reason, shown, points); site rules need a website.
_SITE = "coalesce(has_website, true)"
_W, _I, _P = "coalesce(words, 0)", "coalesce(images, 0)", "coalesce(pages, 0)"
_AGE = f"greatest(0, {AS_OF_YEAR} - coalesce(latest_year, {AS_OF_YEAR}))"
_HEAVY = "regexp_matches(framework, '(^|,)(Angular|React|Vue|Ember.js)(,|$)')"
_NO_JS = "framework = 'Unknown' AND coalesce(NOT uses_js, false)"
_PLAIN = "NOT coalesce(ssl_bad, false) AND http_allowed AND NOT coalesce(to_https, true)"
_RULES = [
    ("coalesce(attributes, -1) <> -1 AND attributes <= 4", "concat('Few GBP attributes (', CAST(attributes AS STRING), ')')", 30, 30),
    ("NOT coalesce(gbp_has_image, false)", "'No image in GBP'", 100, 100),
    ("n_categories = 1", "'Only one category'", 30, 30),
    ("NOT coalesce(verified, true)", "'Unverified Google Business Profile'", 120, 120),
    ("NOT coalesce(has_phone, false)", "'No phone number'", 10, 10),
    ("coalesce(has_phone, false) AND phone_plus", "'Phone number starts with +'", 10, 10),
    ("NOT has_address", "'No address'", 30, 30),
    ("coalesce(listed, 0) <= 1", "concat('Few GBP attributes (', CAST(coalesce(listed, 0) AS STRING), ')')", 40, 40),
    ("NOT coalesce(gbp_has_image, false)", "'No image in GBP'", 40, 40),
    (f"NOT {_SITE}", "'No website listed in GBP'", 120, 120),
    (f"{_SITE} AND coalesce(ssl_bad, false)", "'Invalid or expired SSL certificate'", 120, 120),
    (f"{_SITE} AND {_PLAIN}", "'HTTP access allowed (no forced HTTPS)'", 100, 100),
    (f"{_SITE} AND NOT coalesce(responsive, true)", "'Not responsive'", 100, 100),
    (f"{_SITE} AND builders LIKE '%Squarespace%'", "'One-page site builder (Squarespace)'", 80, 30),
    (f"{_SITE} AND builders LIKE '%Wix%'", "'One-page site builder (Wix)'", 80, 30),
    (f"{_SITE} AND builders LIKE '%Carrd%'", "'One-page site builder (Carrd)'", 80, 30),
    (f"{_SITE} AND NOT favicon", "'No favicon'", 40, 40),
    (f"{_SITE} AND NOT html5", "'Not using HTML5'", 60, 60),
    (f"{_SITE} AND generic", "'Generic title'", 20, 20),
    (f"{_SITE} AND NOT described", "'No meta description'", 20, 20),
    (f"{_SITE} AND NOT h1", "'No H1 tag'", 30, 30),
    (f"{_SITE} AND NOT coalesce(analytics, true)", "'No analytics or tracking'", 25, 25),
    (f"{_SITE} AND {_W} < 200", f"concat('Low text content (', CAST({_W} AS STRING), ' words)')", f"least(80, (200 - {_W}) // 5)", None),
    (f"{_SITE} AND {_I} < 3", f"concat('Few images (', CAST({_I} AS STRING), ')')", f"least(60, 15 * (3 - {_I}))", None),
    (f"{_SITE} AND {_AGE} > 1", f"concat('Very old content (', CAST({_AGE} AS STRING), ' years old)')", f"least(150, 15 * {_AGE})", None),
    (f"{_SITE} AND sitemap_found IS NOT NULL AND {_P} < 5", f"concat('Small sitemap (', CAST({_P} AS STRING), ' pages)')", f"10 * (5 - {_P})", None),
    (f"{_SITE} AND sitemap_found IS NULL", "'No sitemap found'", 30, 30),
    (f"{_SITE} AND {_HEAVY}", "concat('Frameworks detected (', replace(framework, ',', ', '), ')')", 40, 30),
    (f"{_SITE} AND {_NO_JS}", "'No JavaScript'", 30, 30),
    (f"{_SITE} AND framework = 'Unknown' AND NOT coalesce(NOT uses_js, false) AND jquery", "'jQuery'", 30, 30),
    (f"{_SITE} AND seconds > 3", "concat('Slow load time (', format('{:.1f}', seconds), 's)')", "least(50, CAST(floor(5 * (seconds - 3)) AS INT))", None),
]


def _points() -> str:
    terms = [f"CASE WHEN {c} THEN {p if p is not None else shown} ELSE 0 END" for c, _, shown, p in _RULES]
    return f"CAST({' + '.join(terms)} AS INT)"


_KEY_LIST = ", ".join(_KEYS)
_REASONS = " UNION ALL ".join(
    f"SELECT {_KEY_LIST}, {i} AS seq, {reason} AS reason, CAST({shown} AS INT) AS shown FROM m WHERE {condition}"
    for i, (condition, reason, shown, _) in enumerate(_RULES)
)


def metrics(spark, d):
    rows = st.derive(spark, d, "lineitem", {**_KEYS, **METRICS})
    return rows.select(
        *_KEYS, "attributes", "gbp_has_image", "n_categories", F.col("verified").alias("gbp_is_verified"),
        F.col("has_phone").alias("hasPhone"), F.col("phone_plus").alias("phoneStartsWithPlus"), F.col("has_address").alias("hasAddress"),
        F.col("listed").alias("gbp_amount_of_attributes"), "has_website",
        F.struct("ssl_bad", "http_allowed", F.col("to_https").alias("redirects_to_https")).alias("isHttpAllowed"),
        "responsive", F.struct(F.split("builders", ",").alias("builders_detected")).alias("siteBuilder"), "favicon", "html5",
        F.struct(F.col("generic").alias("is_generic")).alias("genericTitle"), F.col("described").alias("metaDescription"), "h1", "analytics",
        "words", "images", F.struct(F.col("latest_year").alias("latest_year_in_text")).alias("lastUpdate"),
        F.struct("sitemap_found", F.col("pages").alias("total_pages")).alias("sitemap"), F.split("framework", ",").alias("framework"),
        F.col("uses_js").alias("usesJs"), "jquery", F.struct(F.col("seconds").cast("double").alias("load_time_seconds")).alias("speedMetrics"),
    )


def _scored(spark, d):
    return scoring.quality_score(metrics(spark, d), AS_OF_YEAR)


@query("score_sum", f"{_ROWS} SELECT {_KEY_LIST}, {_points()} AS score, {_points()} >= 60 AS is_bad FROM m")
def score_sum(spark, d):
    return _scored(spark, d).select(*_KEYS, "score", "is_bad")


_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query(
    "sort_reasons",
    f"""{_ROWS}, r AS ({_REASONS}) SELECT {_ID},
        coalesce(string_agg(concat(reason, '=', CAST(shown AS STRING)), '; ' ORDER BY shown DESC, seq), '') AS reasons
    FROM (SELECT {_ID} FROM m) AS k LEFT JOIN r USING ({_ID}) GROUP BY {_ID}""",
)
def sort_reasons(spark, d):
    text = "array_join(transform(reasons, r -> concat(r.reason, '=', r.penalty)), '; ') AS reasons"
    return _scored(spark, d).selectExpr(*_ID.split(", "), text)


@query(
    "score_summary",
    f"""{_ROWS}, s AS (SELECT {_points()} AS score FROM m) SELECT score >= 60 AS is_bad, count(*) AS businesses, sum(score) AS points FROM s GROUP BY 1""",
)
def score_summary(spark, d):
    return _scored(spark, d).groupBy("is_bad").agg(F.count("*").alias("businesses"), F.sum("score").alias("points"))


# The profile's columns under the names the rules use.
_PROFILED = f"""WITH prof AS ({PROFILE_SQL}), m AS (SELECT *, has_image AS gbp_has_image, CAST(NULL AS INT) AS listed,
    redirects_to_https AS to_https, is_generic AS generic, total_pages AS pages, load_seconds AS seconds FROM prof)"""
_APPLIED = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, *_ in _RULES)


@query(
    "profile_and_score",
    f"{_PROFILED} SELECT page_id, {_points()} AS score, {_points()} >= 60 AS is_bad, CAST({_APPLIED} AS INT) AS reasons FROM m",
)
def profile_and_score(spark, d):
    """Pages to scores in one go."""
    return scored_profile(spark, d).select("page_id", "score", "is_bad", F.size("reasons").alias("reasons"))
