"""Text cleaning and number extraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from prospectry.constants import NOISE_CATEGORIES

# Fixed value: every character that counts as blank in Unicode text, not only ASCII.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
BLANK_CLASS = r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
WORD_CLASS = r"[\p{L}\p{N}_]"


_NOT_BLANK = "[^" + BLANK_CLASS[1:]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once.

    An expression named several times in a formula is pasted in each place when projections are
    merged; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    """Trim every kind of blank. Most text has none at its ends, which two characters tell."""
    blanks = F.lit(BLANKS)
    ends = blanks.contains(F.left(c, F.lit(1))) | blanks.contains(F.right(c, F.lit(1)))
    return F.when(ends, F.btrim(c, blanks)).otherwise(c)


def is_blank(c: Column) -> Column:
    """True for null and for text of blanks only."""
    return ~F.coalesce(c.rlike(_NOT_BLANK), F.lit(False))


def is_blank_or(c: Column, word: str) -> Column:
    """Blank, or ``word`` in any case with blanks around it."""
    found = c.rlike(rf"(?i)^{BLANK_CLASS}*+(?!{word}{BLANK_CLASS}*+$){_NOT_BLANK}")
    return ~F.coalesce(found, F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.when(c.rlike(_NOT_BLANK), c)


def clean_text(c: Column) -> Column:
    """Collapse runs of blanks and trim; nothing left means null."""
    return F.nullif(F.trim(F.regexp_replace(c, BLANK_CLASS + "+", " ")), F.lit(""))


def normalize_status(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))


def extract_int(c: Column) -> Column:
    """First digit run, thousands commas dropped; a number beyond 64 bits is null."""
    return F.replace(F.regexp_extract(c, r"(\d[\d,]*)", 1), F.lit(",")).try_cast("long")


def extract_float(c: Column) -> Column:
    return F.regexp_extract(c, r"\d+(?:\.\d+)?", 0).try_cast("double")


def to_integer(c: Column, default: int | None) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default).cast("int"))


def to_rating(c: Column, dtype: str) -> Column:
    """Numeric rating, or null for anything that is not a number (NaN included).

    A double column is passed through untouched except for NaN, so comparisons on it reach
    the Parquet scan. The Java number suffixes (``4.5d``) are not numbers here.
    """
    if dtype in ("double", "float"):
        return F.when(~F.isnan(c), c.cast("double"))
    if dtype != "string":
        return c.cast("double")
    number = F.when(~c.rlike(r"[0-9.][dDfF]\s*$"), c.try_cast("double"))
    return F.when(~F.isnan(number), number)


def normalize_category(c: Column) -> Column:
    return F.rtrim(F.coalesce(clean_text(c), F.lit("")), F.lit(": "))


def is_noise_category(c: Column) -> Column:
    return F.lower(normalize_category(c)).isin(NOISE_CATEGORIES)


def count_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD_CLASS + "+")), F.lit(0))


def latest_year(c: Column) -> Column:
    """Largest year 2010-2039 written anywhere in the text, inside longer digit runs too."""
    years = F.regexp_extract_all(c, F.lit(r"(20[1-3][0-9])"), F.lit(1))
    return F.array_max(years).cast("int")


def has_updated_phrase(c: Column) -> Column:
    pattern = (
        rf"(?iu)updated{BLANK_CLASS}*(?:on|:)?{BLANK_CLASS}*{WORD_CLASS}*{BLANK_CLASS}*[0-9]{{4}}"
    )
    return F.coalesce(c.rlike(pattern), F.lit(False))


def no_match(rows: DataFrame) -> Column:
    """A key that equals no trimmed text, different for different rows, so that null keys of a join do not meet in one task."""
    plain = [F.col(n) for n, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    return F.concat(F.lit("\x00 "), F.pmod(F.xxhash64(*plain), F.lit(1 << 16)).cast("string"))


def one_decimal(c: Column) -> Column:
    """Text of a non-negative double with one decimal, rounded on its exact binary value.

    A half-way test on the printed digits would round 4.35 up although the stored number is
    below it. ``8f - m`` and then ``+ 2f`` are both exact next to a half-way point ``m``.
    """
    whole = F.floor(c)
    part = c - whole
    tenth = F.floor(part * 10)
    excess = (part * 8 - (tenth + F.lit(0.5))) + part * 2
    up = F.when((excess > 0) | ((excess == 0) & (tenth % 2 == 1)), 1).otherwise(0)
    tenths = (whole * 10 + tenth + up).cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
