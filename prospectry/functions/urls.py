"""URL parts, search slugs and place identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from prospectry.constants import (
    CID_URL, FALLBACK_SLUG, KG_SEARCH_URL, KG_SHORT_URL, PHOTO_SIZE, PHOTO_URL, PLACE_URL,
)
from prospectry.functions.text import BLANK_CLASS, let, strip


def percent_decode(c: Column, plus_is_blank: bool = True) -> Column:
    """Percent-decode, keeping a ``%`` that starts no valid escape."""
    if not plus_is_blank:
        c = F.replace(c, F.lit("+"), F.lit("%2B"))
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def _query_part(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)


def _path_part(url: Column) -> Column:
    path = F.regexp_extract(url, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, r"(?s);[^/]*$", "")


def _first_value(query: Column, name: str) -> Column:
    """Decoded value of the first non-empty parameter called ``name``; null if there is none."""
    raw = F.regexp_extract(query, rf"(?s)(?:^|&){name}=([^&]+)", 1)
    return F.when(raw != "", percent_decode(raw))


def query_slug(url: Column) -> Column:
    """File-name slug of a map search URL.

    The ``q`` (else ``query``) parameter is already decoded when read and is decoded once
    more with the rest, the path form only once.
    """
    url = F.regexp_replace(F.ltrim(url), r"[\t\r\n]", "")
    query, path = _query_part(url), _path_part(url)
    asked = F.coalesce(_first_value(query, "q"), _first_value(query, "query"))
    searched = F.regexp_extract(path, r"(?s)/maps/search/(.*)$", 1)
    last = F.regexp_extract(path, r"(?s)([^/]*)/*$", 1)
    raw = let(
        asked,
        lambda a: F.when(strip(a) != "", a).when(path.contains("/maps/search/"), searched).otherwise(last),
    )
    text = let(F.lower(percent_decode(raw)), strip)
    text = F.regexp_replace(text, r'[\\/:*?"<>|]+', " ")
    text = F.trim(F.regexp_replace(text, BLANK_CLASS + "+", " "))
    slug = F.translate(text, " ,.", "___")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(FALLBACK_SLUG))


def url_host(url: Column) -> Column:
    parts = F.split(url, "/")
    authority = F.when(url.contains("//"), F.get(parts, 2)).otherwise(F.get(parts, 0))
    return F.regexp_extract(authority, r"^([^:?]*)", 1)


def root_domain(url: Column) -> Column:
    """Last two labels of the host, three when both of them have two letters."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    last, second = F.get(labels, F.size(labels) - 1), F.get(labels, F.size(labels) - 2)
    keep = F.when((F.length(last) == 2) & (F.length(second) == 2), 3).otherwise(2)
    return F.when(F.size(labels) <= 2, host).otherwise(
        F.array_join(F.slice(labels, F.size(labels) - keep + 1, keep), ".")
    )


def url_param(url: Column, name: str) -> Column:
    raw = F.regexp_extract(url, rf"{name}=([^&]+)", 1)
    return F.when(raw != "", percent_decode(raw, plus_is_blank=False))


def site_urls(url: Column) -> Column:
    """Plain-HTTP form, domain and base address of a site."""
    http = F.replace(strip(url), F.lit("https://"), F.lit("http://"))
    domain = F.get(F.split(http, "/"), 2)
    return F.struct(
        http.alias("http_url"), domain.alias("domain"),
        F.concat(F.lit("http://"), domain).alias("base_url"),
    )


def _without_dots(segments: Column) -> Column:
    """Path segments with ``.`` and ``..`` resolved; a path that ends in one of them ends in a slash."""

    def step(kept: Column, segment: Column) -> Column:
        shorter = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(segment == "..", shorter).when(segment == ".", kept).otherwise(F.array_append(kept, segment))

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    return F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)


def resolve_href(base: Column, href: Column) -> Column:
    """Absolute address of a link found on a page whose base is ``scheme://host``."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    link = F.regexp_replace(href, "(?s)#.*$", "")
    path, query = F.regexp_extract(link, r"(?s)^([^?]*)", 1), F.regexp_extract(link, r"(?s)^[^?]*(\?.*)$", 1)
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    # Empty segments in between only count in a path that starts at the root.
    relative = F.filter(segments, lambda x, i: (x != "") | (i == F.size(segments) - 1))
    joined = F.array_join(_without_dots(F.when(path.startswith("/"), segments).otherwise(relative)), "/")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(path == "", F.concat(base, F.when(query == "?", "").otherwise(query)))
        .otherwise(F.concat(base, F.lit("/"), joined, query))
    )


def classify_place_id(c: Column) -> Column:
    """Kind of a place identifier and the page that shows it."""
    digits = c.rlike(r"^\s*[+-]?[0-9]+(?:\.0*)?\s*$") & F.length(c).between(16, 24)
    kind = (
        F.when(digits, "cid")
        .when(c.startswith("ChI"), "place_id")
        .when(c.startswith("/g/") | c.startswith("/m/"), "kg")
    )
    prefix = (
        F.when(kind == "cid", CID_URL).when(kind == "place_id", PLACE_URL).when(kind == "kg", KG_SHORT_URL)
    )
    return F.struct(kind.alias("kind"), F.concat(prefix, strip(c)).alias("lookup_url"))


# Numbers are kept as decimal groups, the lowest first. Six hex digits more multiply them by 16**6.
_GROUP, _GROUP_DIGITS, _HEX_DIGITS = 10**9, 9, 6


def _times_and_add(groups: Column, digits: Column) -> Column:
    """``groups`` * 16**6 + ``digits`` (six hex digits), group by group with a carry, which always fits one group."""

    def step(state: Column, group: Column) -> Column:
        total = group * 16**_HEX_DIGITS + state["carry"]
        rest = total % _GROUP
        # A multiple of the group, so the division is exact.
        return F.struct(F.array_append(state["out"], rest).alias("out"), ((total - rest) / _GROUP).cast("long").alias("carry"))

    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.conv(digits, 16, 10).cast("long").alias("carry"))
    return F.aggregate(groups, start, step, lambda s: F.array_append(s["out"], s["carry"]))


def hex_to_decimal(digits: Column) -> Column:
    """Decimal text of a hexadecimal number of any length; null for other text."""
    short = F.conv(digits, 16, 10)  # exact up to 64 bits
    padded = F.lpad(digits, F.ceil(F.length(digits) / _HEX_DIGITS).cast("int") * _HEX_DIGITS, "0")
    groups = F.aggregate(F.regexp_extract_all(padded, F.lit("(.{%d})" % _HEX_DIGITS), F.lit(1)), F.array().cast("array<bigint>"), _times_and_add)
    text = F.array_join(F.transform(F.reverse(groups), lambda g: F.lpad(g.cast("string"), _GROUP_DIGITS, "0")), "")
    long = F.regexp_replace(text, "^0+(?=.)", "")
    return F.when(digits.rlike("^[0-9A-Fa-f]{1,16}$"), short).when(digits.rlike("^[0-9A-Fa-f]+$"), long)


def fid_to_cid(fid: Column) -> Column:
    """The number, as text, behind the second half of a feature id."""
    return hex_to_decimal(F.regexp_extract(fid, r":0x([0-9A-Fa-f]+)", 1))


def extract_place_ids(html: Column, url: Column) -> Column:
    """Feature and place id marked in a page, the feature id else from its address; ``0`` if absent."""
    tagged = F.regexp_extract(html, r"<[^<]+data-fid=['\"]([^'\"]+)['\"][^>]+>", 1)
    in_url = F.regexp_extract(url, r"(?s)(0x[^!]*)!", 1)
    place = F.regexp_extract(html, r"<[^<]+data-pid=['\"](Ch[^'\"]+)['\"][^>]+>", 1)

    def found(*values: Column) -> Column:
        return F.coalesce(*[F.when(v != "", v) for v in values], F.lit("0"))

    fid = found(tagged, in_url)
    return F.struct(
        fid.alias("fid"), found(place).alias("place_id"),
        F.coalesce(fid_to_cid(fid), F.lit("0")).alias("cid"),
    )


def photo_url(url: Column, width: int, height: int) -> Column:
    """Address of a photo at a wanted size, cut out of the page address that shows it."""
    decoded = percent_decode(url, plus_is_blank=False)
    image = F.regexp_extract(decoded, r"(?s)(https://l.*?)=w", 1)
    return F.when(image != "", F.concat(image, F.lit(f"=w{width}-h{height}-k-no")))


def photo_url_from_id(photo_id: Column) -> Column:
    return F.concat(F.lit(PHOTO_URL), photo_id, F.lit(PHOTO_SIZE))


def kg_url(kg_id: Column) -> Column:
    return F.concat(F.lit(KG_SEARCH_URL), kg_id)


def format_coords(latitude: Column, longitude: Column) -> Column:
    return F.format_string("%.8f, %.8f", latitude, longitude)


def parse_coords(c: Column) -> Column:
    parts = F.split(c, ",")
    latitude = strip(F.get(parts, 0)).try_cast("double")
    longitude = strip(F.get(parts, 1)).try_cast("double")
    return F.when(latitude.isNotNull() & longitude.isNotNull(), F.array(latitude, longitude))
