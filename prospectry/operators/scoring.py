"""Quality score of a business: penalties with reasons, from the site profile.

The rules are a table of SQL expressions: when a rule applies, what it says, the points it adds
and the figure its reason shows. Each condition is looked at once and becomes a bit; score and reasons
follow from the bits. No row leaves the JVM.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from prospectry.constants import PENALIZED_BUILDERS, PENALIZED_FRAMEWORKS
from prospectry.operators.site import NOTHING_FOUND
from prospectry.session import bound_methods
from prospectry.sources import schemas

# Fixed value: from this score on a business counts as bad.
BAD_FROM = 60


class Rule(NamedTuple):
    when: str
    reason: str
    points: str
    shown: str | None = None


def _texts(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


# What a missing metric counts as. Rules read these names.
_KNOWN = {
    "attributes": "coalesce(attributes, -1)",
    "listed": "coalesce(gbp_amount_of_attributes, 0)",
    "has_image": "coalesce(gbp_has_image, false)",
    "categories": "coalesce(n_categories, 0)",
    "verified": "coalesce(gbp_is_verified, true)",
    "phone": "coalesce(hasPhone, false)",
    "plus": "coalesce(phoneStartsWithPlus, false)",
    "address": "coalesce(hasAddress, false)",
    "site": "coalesce(has_website, true)",
    "bad_tls": "coalesce(isHttpAllowed.ssl_bad, false)",
    "plain_http": "coalesce(isHttpAllowed.http_allowed, false) AND NOT coalesce(isHttpAllowed.redirects_to_https, true)",
    "responsive": "coalesce(responsive, true)",
    "builders": "coalesce(siteBuilder.builders_detected, CAST(array() AS array<string>))",
    "favicon": "coalesce(favicon, true)",
    "html5": "coalesce(html5, true)",
    "generic": "coalesce(genericTitle.is_generic, false)",
    "described": "coalesce(metaDescription, true)",
    "h1": "coalesce(h1, true)",
    "analytics": "coalesce(analytics, true)",
    "words": "coalesce(words, 0)",
    "images": "coalesce(images, 0)",
    "age": "greatest(0, {year} - coalesce(nullif(lastUpdate.latest_year_in_text, 0), {year}))",
    "mapped": "coalesce(sitemap.sitemap_found <> '', false)",
    "pages": "coalesce(sitemap.total_pages, 0)",
    "frameworks": "array_join(coalesce(framework, CAST(array() AS array<string>)), ', ')",
    "heavy": f"coalesce(arrays_overlap(framework, {_texts(PENALIZED_FRAMEWORKS)}), false)",
    "unknown": f"coalesce(array_contains(framework, '{NOTHING_FOUND}'), false)",
    "no_js": "coalesce(NOT usesJs, false)",
    "jquery": "coalesce(jquery, false)",
    "seconds": "coalesce(speedMetrics.load_time_seconds, 0D)",
}


def _label(before: str, value: str, after: str = ")") -> str:
    return f"concat('{before}', CAST({value} AS STRING), '{after}')"


# The texts of the reasons and their points.
_LISTING_RULES = [
    Rule("m.attributes <> -1 AND m.attributes <= 4", _label("Few GBP attributes (", "m.attributes"), "30"),
    Rule("NOT m.has_image", "'No image in GBP'", "100"),
    Rule("m.categories = 1", "'Only one category'", "30"),
    Rule("NOT m.verified", "'Unverified Google Business Profile'", "120"),
    Rule("NOT m.phone", "'No phone number'", "10"),
    Rule("m.phone AND m.plus", "'Phone number starts with +'", "10"),
    Rule("NOT m.address", "'No address'", "30"),
    Rule("m.listed <= 1", _label("Few GBP attributes (", "m.listed"), "40"),
    Rule("NOT m.has_image", "'No image in GBP'", "40"),
    Rule("NOT m.site", "'No website listed in GBP'", "120"),
]

_SITE_RULES = [
    Rule("m.bad_tls", "'Invalid or expired SSL certificate'", "120"),
    Rule("NOT m.bad_tls AND m.plain_http", "'HTTP access allowed (no forced HTTPS)'", "100"),
    Rule("NOT m.responsive", "'Not responsive'", "100"),
    *[Rule(f"array_contains(m.builders, '{b}')", f"'One-page site builder ({b})'", "30", "80") for b in PENALIZED_BUILDERS],
    Rule("NOT m.favicon", "'No favicon'", "40"),
    Rule("NOT m.html5", "'Not using HTML5'", "60"),
    Rule("m.generic", "'Generic title'", "20"),
    Rule("NOT m.described", "'No meta description'", "20"),
    Rule("NOT m.h1", "'No H1 tag'", "30"),
    Rule("NOT m.analytics", "'No analytics or tracking'", "25"),
    Rule("m.words < 200", _label("Low text content (", "m.words", " words)"), "least(80, CAST(0.2D * (200 - m.words) AS INT))"),
    Rule("m.images < 3", _label("Few images (", "m.images"), "least(60, 15 * (3 - m.images))"),
    Rule("m.age > 1", _label("Very old content (", "m.age", " years old)"), "least(150, 15 * m.age)"),
    Rule("m.mapped AND m.pages < 5", _label("Small sitemap (", "m.pages", " pages)"), "10 * (5 - m.pages)"),
    Rule("NOT m.mapped", "'No sitemap found'", "30"),
    Rule("m.heavy", _label("Frameworks detected (", "m.frameworks"), "30", "40"),
    Rule("NOT m.heavy AND m.unknown AND m.no_js", "'No JavaScript'", "30"),
    Rule("NOT m.heavy AND m.unknown AND NOT m.no_js AND m.jquery", "'jQuery'", "30"),
    Rule("m.seconds > 3", _label("Slow load time (", "m.seconds_text", "s)"), "least(50, CAST(5 * (m.seconds - 3) AS INT))"),
]

RULES = [*_LISTING_RULES, *[r._replace(when=f"m.site AND {r.when}") for r in _SITE_RULES]]

# Load time with one decimal, rounded on the exact binary value: a half-way test on printed
# digits would round 4.35 up although the stored number is below it. ``8f - h`` and then ``+ 2f``
# are both exact next to a half-way point ``h`` of the fraction ``f``.
def _tenths(t: str) -> str:
    fraction = f"({t} - floor({t}))"
    digit = f"floor({fraction} * 10)"
    past_half = f"(({fraction} * 8 - ({digit} + 0.5D)) + {fraction} * 2)"
    return f"(floor({t}) * 10 + {digit} + CASE WHEN {past_half} > 0 OR ({past_half} = 0 AND {digit} % 2 = 1) THEN 1 ELSE 0 END)"


def _seconds_text(t: str) -> str:
    """Repeats are worked out once: generated code shares equal parts, while a lambda would not be generated."""
    return f"concat(CAST({_tenths(t)} DIV 10 AS STRING), '.', CAST({_tenths(t)} % 10 AS STRING))"


def with_metric_columns(metrics: DataFrame) -> DataFrame:
    """Add each missing metric as typed null, so that null and absent read alike."""
    missing = {
        f.name: F.lit(None).cast(f.dataType) for f in schemas.SITE_METRICS.fields if f.name not in metrics.columns
    }
    return metrics.withColumns(missing) if missing else metrics


def known_metrics(as_of_year: int) -> str:
    """One struct with every metric a rule reads, unknown values replaced."""
    fields = [f"'{n}', {e.format(year=as_of_year)}" for n, e in _KNOWN.items()]
    slow = f"CASE WHEN speedMetrics.load_time_seconds > 3 THEN {_seconds_text('speedMetrics.load_time_seconds')} END"
    return f"named_struct({', '.join(fields)}, 'seconds_text', {slow})"


def hits() -> str:
    """One bit for each rule that applies; no rule's condition is looked at anywhere else."""
    return " + ".join(f"CASE WHEN {r.when} THEN {1 << i}L ELSE 0L END" for i, r in enumerate(RULES))


def _applies(i: int) -> str:
    return f"(hits & {1 << i}L) <> 0"


def score_sum() -> str:
    """Points of the rules that apply, from ``hits`` and the metrics ``m``."""
    return " + ".join(f"CASE WHEN {_applies(i)} THEN {r.points} ELSE 0 END" for i, r in enumerate(RULES))


# A key holds the negative penalty, the place among equals and the rule, so ascending keys are reasons in order.
_PENALTY_BITS, _RULE_BITS = 22, 6
_NO_KEY = (1 << 63) - 1


def sort_keys() -> str:
    """Keys of the rules that apply, largest shown penalty first, rule order among equals.

    Sorting an array of numbers without nulls needs no comparisons of structs; rules that do not apply sort to the
    end, where the number of bits cuts them off. Builders come in the order they were detected.
    """

    def key(i: int, r: Rule) -> str:
        place = f"{i}000"
        if "builder (" in r.reason:
            builder = r.reason.split("(")[1].split(")")[0]
            place = f"{len(_LISTING_RULES) + 3}000 + array_position(m.builders, '{builder}')"
        value = f"-CAST({r.shown or r.points} AS BIGINT) * {1 << _PENALTY_BITS}L + ({place}) * {1 << _RULE_BITS}L + {i}L"
        return f"CASE WHEN {_applies(i)} THEN {value} ELSE {_NO_KEY}L END"

    return f"slice(sort_array(array({', '.join(key(i, r) for i, r in enumerate(RULES))})), 1, bit_count(hits))"


def reason_texts() -> str:
    """The text of every rule; those with a figure only where they apply."""
    return "array(" + ", ".join(r.reason if r.reason.startswith("'") else f"CASE WHEN {_applies(i)} THEN {r.reason} END" for i, r in enumerate(RULES)) + ")"


def quality_score(metrics: DataFrame, as_of_year: int) -> DataFrame:
    """Adds ``score``, ``is_bad`` and the sorted ``reasons``; the year is an argument so results repeat.

    Thirty rules make one long generated method, which the JVM would not compile.
    ``spark.sql.codegen.hugeMethodLimit`` makes Spark cut such a method into short ones, whatever session runs it.
    """
    bound_methods(metrics.sparkSession)
    own = [f"`{c}`" for c in metrics.columns]
    known = with_metric_columns(metrics).selectExpr(*own, f"{known_metrics(as_of_year)} AS m").selectExpr(*own, "m", f"{hits()} AS hits")
    scored = known.selectExpr(*own, f"{score_sum()} AS score", f"{sort_keys()} AS keys", f"{reason_texts()} AS texts")
    # Only the reasons that apply are looked up, outside the generated code. Keys and texts are named twice, which
    # keeps the optimizer from pasting their formulas into the look-up of each reason.
    reason = f"named_struct('reason', texts[CAST(k & {(1 << _RULE_BITS) - 1} AS INT)], 'penalty', CAST(-shiftright(k, {_PENALTY_BITS}) AS INT))"
    return scored.selectExpr(*own, "score", f"score >= {BAD_FROM} AS is_bad", f"CASE WHEN size(keys) > 0 AND size(texts) > 0 THEN transform(keys, k -> {reason}) ELSE array() END AS reasons")
