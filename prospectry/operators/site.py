"""Page-quality signals of a business's web site.

Signals that need only the page source are plain string expressions. The others read the
``page`` struct that :func:`page_features` adds, so a page is parsed once for all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from prospectry.constants import ANALYTICS_PATTERNS, FRAMEWORKS, GENERIC_TITLES, SITE_BUILDERS
from prospectry.functions import markup
from prospectry.functions.text import BLANK_CLASS, BLANKS, count_words, has_updated_phrase, latest_year, let, strip
from prospectry.functions.urls import resolve_href, site_urls
from prospectry.sources import schemas

NOTHING_FOUND = "Unknown"


def page_features(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the HTML by a struct of texts, counts, metas, scripts and styles."""
    return markup.parse_column(pages, html, markup.site_page_facts, schemas.PAGE_MARKUP, "page")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column, patterns: list[str]) -> Column:
    return _any([text.contains(p) for p in patterns])


def _named_or_unknown(flags: list[tuple[str, Column]]) -> Column:
    found = F.filter(F.array(*[F.when(c, name) for name, c in flags]), lambda n: n.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NOTHING_FOUND)))


# --- from the page source ------------------------------------------------------------------


def has_favicon(html: Column) -> Column:
    return html.contains('<link rel="icon"')


def is_html5(html: Column) -> Column:
    # Only the head of the text matters, so only that much is lowered.
    head = F.substring(F.ltrim(html, F.lit(BLANKS)), 1, 15)
    return F.lower(head) == "<!doctype html>"


def site_builders(html: Column) -> Column:
    """Builders whose marks occur in the page, in catalogue order.

    The catalogue is a handful of constants, so it becomes a chain of substring tests on the
    page instead of a join.
    """

    def found(lowered: Column) -> Column:
        return _named_or_unknown(
            [(b, contains_any(lowered, [m.lower() for m in marks])) for b, marks in SITE_BUILDERS.items()]
        )

    return let(F.lower(html), found)


def framework_marks(html: Column) -> Column:
    """Names of the frameworks whose text marks occur in the page source."""
    return let(
        html, lambda text: F.filter(F.array(*[F.when(contains_any(text, f["text"]), f["name"]) for f in FRAMEWORKS if "text" in f]), lambda n: n.isNotNull())
    )


def source_signals(html: Column) -> Column:
    """All that is read from the page source alone, as one small struct.

    It is made before the page is parsed, so the source goes into the parser once and never comes out of it.
    """
    return F.struct(
        has_favicon(html).alias("favicon"), is_html5(html).alias("html5"), site_builders(html).alias("builders"), framework_marks(html).alias("framework_marks")
    )


# --- from the parsed page ------------------------------------------------------------------


def _meta(page: Column, field: str, value: str) -> Column:
    """First meta element whose ``field`` equals ``value``."""
    return F.get(F.filter(page["metas"], lambda m: m[field] == value), 0)


def words(page: Column) -> Column:
    return count_words(page["text"])


def generic_title(page: Column) -> Column:
    title = F.coalesce(strip(page["title"]), F.lit(""))
    return F.struct(title.alias("title"), F.lower(title).isin(GENERIC_TITLES).alias("is_generic"))


def has_h1(page: Column) -> Column:
    return page["h1_count"] > 0


def has_meta_description(page: Column) -> Column:
    return F.coalesce(strip(_meta(page, "name", "description")["content"]) != "", F.lit(False))


def has_analytics(page: Column) -> Column:
    return F.exists(
        page["scripts"],
        lambda s: contains_any(F.coalesce(s["src"], F.lit("")), ANALYTICS_PATTERNS)
        | contains_any(F.coalesce(s["body"], F.lit("")), ANALYTICS_PATTERNS),
    )


def _in_browser(captured: Column | None, name: str) -> Column:
    """A global seen in the browser; false where no map was captured."""
    if captured is None:
        return F.lit(False)
    return F.coalesce(F.try_element_at(captured, F.lit(name)), F.lit(False))


def detect_jquery(page: Column, captured: Column | None = None) -> Column:
    loaded = F.exists(
        page["scripts"], lambda s: F.coalesce(F.lower(s["src"]).contains("jquery"), F.lit(False))
    )
    return loaded | _in_browser(captured, "jQuery") | _in_browser(captured, "$")


def detect_frameworks(html: Column, page: Column, captured: Column | None = None) -> Column:
    return frameworks_of(framework_marks(html), page, captured)


def frameworks_of(marks: Column, page: Column, captured: Column | None = None) -> Column:
    """Frameworks by their marks in the source, metas, attributes and browser globals; some hide others."""

    def found(named: Column) -> Column:
        flags: dict[str, Column] = {}
        for f in FRAMEWORKS:
            tests = [F.array_contains(named, f["name"])] if "text" in f else []
            if "meta" in f:
                tests.append(_meta(page, "name", f["meta"]).isNotNull())
            if "attribute" in f:
                tests.append(F.array_contains(page["marked_attributes"], f["attribute"]))
            if "global" in f:
                tests.append(_in_browser(captured, f["global"]))
            hidden_by = f.get("hidden_by")
            flags[f["name"]] = _any(tests) & ~flags[hidden_by] if hidden_by else _any(tests)
        return _named_or_unknown(list(flags.items()))

    return let(marks, found)


def last_update(page: Column, last_modified: Column) -> Column:
    text = F.coalesce(page["full_text"], page["text"])
    by_property, by_name = _meta(page, "property", "article:modified_time"), _meta(page, "name", "last-modified")
    meta_date = F.when(by_property.isNotNull(), by_property["content"]).otherwise(by_name["content"])
    return F.struct(
        last_modified.alias("last_modified_header"), meta_date.alias("meta_date"),
        latest_year(text).alias("latest_year_in_text"), has_updated_phrase(text).alias("has_updated_phrase"),
    )


def has_viewport(page: Column) -> Column:
    return _meta(page, "name", "viewport").isNotNull()


# What the fold below looks at: brackets, ends of statements, at-keywords, and that something else stands there.
_CSS_TOKEN = r"(<!--|-->|@[-\p{L}\p{N}_]+|[{}()\[\];]|[^\s{}()\[\];@<\-]+|\S)"
_FRESH, _AT_RULE, _QUALIFIED = 0, 1, 2


def _css_step(state: Column, token: Column) -> Column:
    """State after one token: which rule we are in, the closing brackets still due, and the verdict.

    Only a block, or for an at-rule also a semicolon, ends a rule. A closing bracket that is not due is ignored.
    """
    mode, due = state["mode"], state["due"]
    closer = F.element_at(F.create_map(*[F.lit(x) for x in ("{", "}", "(", ")", "[", "]")]), token)
    inside, closes = due != "", F.substring(due, 1, 1) == token
    left = F.when(closer.isNotNull(), F.concat(closer, due)).when(inside & closes, F.substr(due, F.lit(2))).otherwise(due)
    started = F.when(token.startswith("@"), _AT_RULE).when(token.isin("<!--", "-->"), _FRESH).otherwise(_QUALIFIED)
    after = (
        F.when(inside, F.when(closes & (F.length(due) == 1) & (token == "}"), _FRESH).otherwise(mode))
        .when(mode == _FRESH, started)
        .when((mode == _AT_RULE) & (token == ";"), _FRESH)
        .otherwise(mode)
    )
    found = state["found"] | (~inside & (mode == _FRESH) & (F.lower(token) == "@media"))
    return F.struct(after.cast("int").alias("mode"), left.alias("due"), found.alias("found"))


def has_top_level_media(css: Column) -> Column:
    """A ``@media`` rule that stands outside every other rule, at any depth of nesting of the others."""
    bare = F.regexp_replace(css, r"(?s)/\*.*?(?:\*/|$)", " ")
    bare = F.regexp_replace(bare, r"""(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'""", '""')
    bare = F.regexp_replace(bare, r"(?i)url\(\s*[^\s\"'()\\]*\s*\)", "u")
    tokens = F.regexp_extract_all(bare, F.lit(_CSS_TOKEN), F.lit(1))
    start = F.struct(F.lit(_FRESH).alias("mode"), F.lit("").alias("due"), F.lit(False).alias("found"))
    folded = F.aggregate(tokens, start, _css_step, lambda state: state["found"])
    return F.coalesce(F.when(css.rlike("(?i)@media"), folded).otherwise(False), F.lit(False))


def page_stylesheets(pages: DataFrame, base_url: Column, key: str = "page_id") -> DataFrame:
    """One row per linked style sheet of ``stylesheets``, resolved against the page's base."""
    links = pages.select(key, base_url.alias("_base"), F.explode("stylesheets").alias("href"))
    css_url = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(
        resolve_href(F.col("_base"), F.col("href"))
    )
    return links.select(key, css_url.alias("css_url"))


def responsive_stylesheets(css_capture: DataFrame) -> DataFrame:
    """Addresses of style sheets that arrived and hold a top-level ``@media`` rule."""
    good = css_capture.where((F.col("status_code") == 200) & has_top_level_media(F.col("body")))
    return good.select("css_url").distinct()


def layout_signals() -> dict[str, Column]:
    """What a page itself tells about its layout; :func:`is_responsive` adds the linked sheets."""
    return {
        "viewport": has_viewport(F.col("page")),
        "inline_media": F.exists("page.styles", has_top_level_media),
        "stylesheets": F.col("page.stylesheets"),
    }


def is_responsive(pages: DataFrame, css_capture: DataFrame, base_url: Column, key: str = "page_id") -> DataFrame:
    """Key and verdict from the layout signals: a viewport meta and a media rule, inline or linked.

    Only pages that need it reach the join: those with a viewport and no inline rule. Each
    style sheet is judged once, however many pages share it.
    """
    undecided = pages.where(F.col("viewport") & ~F.col("inline_media"))
    linked = (
        page_stylesheets(undecided, base_url, key)
        .join(responsive_stylesheets(css_capture), "css_url", "left_semi")
        .select(key).distinct().withColumn("_linked", F.lit(True))
    )
    verdict = F.col("viewport") & (F.col("inline_media") | F.coalesce("_linked", F.lit(False)))
    return pages.join(linked, key, "left").select(key, verdict.alias("responsive"))


def uses_js(rendered: DataFrame, raw: DataFrame, key: str = "page_id") -> DataFrame:
    """More words after rendering than in the raw page."""
    before = page_features(raw).select(key, words(F.col("page")).alias("_before"))
    after = page_features(rendered).select(key, words(F.col("page")).alias("_after"))
    return after.join(before, key).select(key, (F.col("_after") > F.col("_before")).alias("usesJs"))


def page_metrics(source: Column, captured: Column | None = None) -> dict[str, Column]:
    """Named signals that need nothing but one page: its :func:`source_signals` and its parsed features."""
    page = F.col("page")
    return {
        "framework": frameworks_of(source["framework_marks"], page, captured),
        "genericTitle": generic_title(page),
        "images": page["img_count"],
        "words": words(page),
        "siteBuilder": F.struct(source["builders"].alias("builders_detected")),
        "jquery": detect_jquery(page, captured),
        "analytics": has_analytics(page),
        "metaDescription": has_meta_description(page),
        "h1": has_h1(page),
        "favicon": source["favicon"],
    }


def base_url(url: Column) -> Column:
    return site_urls(url)["base_url"]
