"""Listings and detail panels out of captured results pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from prospectry.functions import markup
from prospectry.functions.lists import dedupe_ci_ordered
from prospectry.functions.text import (
    clean_text, extract_float, extract_int, is_noise_category, normalize_category, strip,
)
from prospectry.functions.urls import kg_url, parse_coords
from prospectry.sources import schemas

# Fixed value: status of a listing whose website anchor has no address.
_NO_HREF_ERROR = "parse_error: 'NoneType' object has no attribute 'startswith'"


def first_match(items: Column) -> Column:
    """First element in document order, null if there is none."""
    return F.get(items, 0)


def _http_only(c: Column) -> Column:
    return F.when(c.startswith("http"), c)


def _explicit_categories(texts: Column) -> Column:
    pieces = F.flatten(
        F.transform(
            F.filter(F.transform(texts, clean_text), lambda t: t.isNotNull()),
            lambda t: F.split(t, r"\s*[·,|/]\s*"),
        )
    )
    named = F.filter(
        F.transform(pieces, strip), lambda p: (F.length(p) > 1) & ~is_noise_category(p)
    )
    normal = F.filter(F.transform(named, normalize_category), lambda p: ~is_noise_category(p))
    return dedupe_ci_ordered(normal)


def _dotted_parts(text: Column) -> Column:
    parts = F.transform(F.split(text, "·"), strip)
    return F.filter(parts, lambda p: F.length(p) > 2)


def _says(text: Column, *words: str) -> Column:
    lowered = F.lower(text)
    said = lowered.contains(words[0])
    for word in words[1:]:
        said = said | lowered.contains(word)
    return said


def with_listing_fields(facts: DataFrame, box: str) -> DataFrame:
    """Fields of one listing from the element facts in struct column ``box``.

    Steps are separate projections, so each cleaned array is computed once and reused.
    """
    b = F.col(box)
    blocks = F.filter(
        F.transform(
            b["blocks"], lambda x: F.struct(clean_text(x["text"]).alias("text"), x["phone"].alias("phone"))
        ),
        lambda x: x["text"].isNotNull(),
    )
    stage = facts.withColumns(
        {"_blocks": blocks, "_explicit": _explicit_categories(b["category_texts"])}
    )
    lines = F.transform("_blocks", lambda x: x["text"])
    dotted = F.filter(lines, lambda t: t.contains("·") & ~_says(t, "open", "closed"))
    stage = stage.withColumns(
        {
            "_parts": F.transform(dotted, _dotted_parts),
            "_status": first_match(F.filter(lines, lambda t: _says(t, "open", "closed", "closes"))),
            "_phones": F.filter("_blocks", lambda x: x["phone"].isNotNull()),
        }
    )
    inferred = F.get(first_match(F.filter("_parts", lambda p: F.size(p) > 0)), 0)
    addressed = first_match(F.filter("_parts", lambda p: F.size(p) > 1))
    stage = stage.withColumns({"_inferred": inferred, "_addressed": addressed})
    no_text = F.array().cast("array<string>")
    categories = (
        F.when(F.size("_explicit") > 0, F.col("_explicit"))
        .when(~is_noise_category(F.col("_inferred")), F.array(normalize_category(F.col("_inferred"))))
        .otherwise(no_text)
    )
    broken = b["has_website_anchor"] & b["website_href"].isNull()
    fields = {
        "name": F.coalesce(clean_text(b["link_label"]), clean_text(b["headline"])),
        "categories": categories,
        "rating": extract_float(b["rating_text"]),
        "reviews_count": extract_int(b["reviews_text"]),
        "address": clean_text(F.try_element_at("_addressed", F.lit(-1))),
        "phone": clean_text(F.try_element_at("_phones", F.lit(-1))["phone"]),
        "website": _http_only(b["website_href"]),
        "listing_link": _http_only(b["link_href"]),
        "status": F.col("_status"),
    }
    failed = {"categories": no_text, "status": F.lit(_NO_HREF_ERROR)}
    kept = [c for c in facts.columns if c != box]
    return stage.select(
        *kept, *[F.when(broken, failed.get(n)).otherwise(v).alias(n) for n, v in fields.items()]
    )


def extract_listings(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per listing container with its 1-based rank on the page.

    Pages without a container are dropped by a JVM-side test before any Python runs.
    """
    boxes = T.ArrayType(schemas.LISTING_MARKUP)
    parsed = markup.parse_column(
        pages.where(F.col(html).contains(markup.ANY_CONTAINER)), html, markup.results_page_facts, boxes, "_boxes"
    )
    kept = [c for c in parsed.columns if c != "_boxes"]
    ranked = parsed.select(*kept, F.posexplode("_boxes").alias("_i", "_box"))
    ranked = ranked.withColumn("position", F.col("_i") + 1).drop("_i")
    return with_listing_fields(ranked, "_box")


def has_listing_image(image_src: Column) -> Column:
    return F.coalesce(~image_src.contains("default_geocode"), F.lit(False))


def _last_row(label: str) -> Column:
    rows = F.filter(F.col("_panel.rows"), lambda r: r["label"].startswith(label))
    return F.try_element_at(rows, F.lit(-1))["value"]


def extract_panels(captures: DataFrame) -> DataFrame:
    """Fields of each captured detail panel; a field whose row is absent is null.

    A capture without panel HTML still tells whether the listing has an image.
    """
    parsed = markup.parse_column(
        captures, "panel_html", markup.panel_facts, schemas.PANEL_MARKUP, "_panel"
    )
    badge = F.lower(strip(F.col("_panel.badge")))
    named = F.transform(F.split(_last_row("Categories"), ","), strip)
    coordinates = F.filter(
        F.transform(
            F.filter(F.col("_panel.rows"), lambda r: r["label"].startswith("Coordinates")),
            lambda r: parse_coords(r["value"]),
        ),
        lambda c: c.isNotNull(),
    )
    count = F.regexp_extract(_last_row("Attributes"), r"^\s*(\S+)", 1).try_cast("int")
    fields = {
        "gbp_company": F.nullif(strip(F.col("_panel.company")), F.lit("")),
        "gbp_is_verified": F.when(badge.contains("not verified"), False).when(badge.contains("verified"), True),
        "categories": F.filter(named, lambda x: x != ""),
        "place_id": _last_row("Place ID"),
        "CID": _last_row("CID"),
        "business_profile_id": _last_row("Business Profile ID"),
        "coordinates": F.try_element_at(coordinates, F.lit(-1)),
        "kg_id": kg_url(_last_row("KG ID")),
        "attributes": F.when(F.col("_panel").isNotNull(), F.coalesce(count, F.lit(-1))),
        "gbp_has_image": has_listing_image(F.col("image_src")),
    }
    kept = [c for c in captures.columns if c not in ("panel_html", "image_src")]
    return parsed.select(*kept, *[v.alias(n) for n, v in fields.items()])


def struct_override(left: Column, right: Column, fields: list[str], shared: list[str]) -> Column:
    """Right side wins field by field where it has a value; other fields pass through."""
    return F.struct(
        *[F.coalesce(right[f], left[f]).alias(f) if f in shared else left[f].alias(f) for f in fields]
    )


def merge_panel_fields(listings: DataFrame, panels: DataFrame, on: tuple[str, ...] = ("page_id", "position")) -> DataFrame:
    """Listing *i* of a page gets the fields of panel *i*; the panel wins on shared names."""
    shared = [c for c in panels.columns if c in listings.columns and c not in on]
    right = panels.withColumnsRenamed({c: f"_panel_{c}" for c in shared})
    joined = listings.join(right, list(on), "left")
    own = [
        F.coalesce(f"_panel_{c}", c).alias(c) if c in shared else F.col(c) for c in listings.columns
    ]
    added = [c for c in panels.columns if c not in listings.columns]
    return joined.select(*own, *added)


# --- what the lookup service adds to a results page ---------------------------------------


def annotate_results(results: DataFrame, lookups: DataFrame, on: tuple[str, ...] = ("page_id", "position")) -> DataFrame:
    """Result *i* gets categories, verified flag and distance of lookup *i*, if that is named."""
    named = lookups.where(F.col("name").isNotNull()).select(
        *on, F.col("cid"), F.array_join("categories", ", ").alias("category_text"),
        F.col("verified"), F.concat(F.lit("Distance: "), F.col("distance").cast("string"), F.lit(" m")).alias("distance_text"),
    )
    return results.join(named, list(on), "left")


def default_display(rows: DataFrame) -> DataFrame:
    """Texts shown for unknown values."""
    return rows.withColumns(
        {
            "reviews_count": F.coalesce(F.col("reviews_count").cast("string"), F.lit("")),
            "rating": F.coalesce(F.col("rating").cast("string"), F.lit("")),
            "address": F.coalesce("address", F.lit("hidden")),
        }
    )


def category_histogram(listings: DataFrame, by: list[str]) -> DataFrame:
    """Listings per category in each search, plus a ``Total Categories`` row.

    Only named listings count, and a search shows nothing unless its total exceeds one. One pass
    over the listings counts both levels; the window sees one row per (search, category).
    """
    named = listings.where(F.col("name").isNotNull()).select(*by, F.explode("categories").alias("category"))
    sets = [[F.col(n) for n in (*by, "category")], [F.col(n) for n in by]]
    counts = named.groupingSets(sets, *by, "category").agg(
        F.count("*").alias("listings"), F.grouping("category").alias("_total")
    )
    total = F.max(F.when(F.col("_total") == 1, F.col("listings"))).over(Window.partitionBy(*by))
    category = F.when(F.col("_total") == 1, "Total Categories").otherwise(F.col("category"))
    return counts.withColumn("_of", total).where("_of > 1").select(*by, category.alias("category"), "listings")
