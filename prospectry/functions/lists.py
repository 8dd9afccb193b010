"""List cells: parsing text into arrays, ordered de-duplication, display text."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

from prospectry.functions.text import BLANK_CLASS, is_blank, let, strip

# Literals as a Python list cell would show them. Possessive repeats keep long cells linear.
_QUOTED = r"""(?:'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+")"""
_NUMBER = r"[-+]?(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:[eE][-+]?+[0-9]++)?+"
_ATOM = rf"(?:{_QUOTED}|{_NUMBER}|None|True|False)"
_GAP = BLANK_CLASS + "*+"
_MORE = rf"(?:{_GAP},{_GAP}{_ATOM})"
_LIST = rf"(?s)^(?:\[{_GAP}(?:{_ATOM}{_MORE}*+{_GAP},?+{_GAP})?+\])$"
_TUPLE = (
    rf"(?s)^(?:\({_GAP}\)|\({_GAP}{_ATOM}{_GAP}(?:,{_GAP}|{_MORE}++{_GAP},?+{_GAP})\)"
    rf"|{_ATOM}{_GAP}(?:,|{_MORE}++{_GAP},?+))$"
)
_SCALAR = rf"(?s)^(?:{_ATOM}|\({_GAP}{_ATOM}{_GAP}\))$"
_MAPPING = (
    rf"(?s)^\{{{_GAP}{_ATOM}{_GAP}(?::{_GAP}{_ATOM}{_GAP})?+"
    rf"(?:,{_GAP}{_ATOM}{_GAP}(?::{_GAP}{_ATOM}{_GAP})?+)*+,?+{_GAP}\}}$"
)


def _unquote(c: Column) -> Column:
    """Value of one literal: quotes removed, common escapes resolved."""
    number = F.when(c.rlike(r"^[-+]?[0-9.]+[.eE]|^[-+]?\."), c.try_cast("double").cast("string")).otherwise(c)
    inner = F.substring(c, F.lit(2), F.length(c) - 2)
    for mark, text in ((r"(?<!\\)((?:\\\\)*)\\n", "\n"), (r"(?<!\\)((?:\\\\)*)\\t", "\t")):
        inner = F.regexp_replace(inner, mark, "$1" + text)
    inner = F.regexp_replace(inner, r"(?s)\\(.)", "$1")
    return F.when(c.rlike("^['\"]"), inner).otherwise(number)


def _literal_items(c: Column) -> Column:
    atoms = F.regexp_extract_all(c, F.lit(rf"(?s)({_ATOM})"), F.lit(1))
    return F.transform(atoms, _unquote)


# Parts of a literal: strings, numbers, words, and any other letter by itself, brackets among them.
_PARTS = rf"(?s)({_QUOTED}|{_NUMBER}|[A-Za-z_]++|[^\s])"
_PYTHON_WORDS = {"True": "True", "False": "False", "None": "None"}
_JSON_WORDS = {"true": "True", "false": "False", "null": "None"}
# The stack of open brackets, one letter each, the innermost first: a list; a tuple with no, one or more commas so
# far; a brace before its first comma or colon, a set, a dict at a key, a dict at a value.
_LIST_OPEN, _TUPLES, _BRACE, _SET, _KEY, _VALUE = "L", "tuv", "b", "s", "k", "w"
_BRACES = [_BRACE, _SET, _KEY, _VALUE]


def _quoted(text: Column) -> Column:
    """Text as Python shows it inside a list."""
    escaped = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    double = text.contains("'") & ~text.contains('"')
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(single)


def _after_comma(top: Column) -> Column:
    """The innermost bracket once a comma was read in it."""
    chain = F.when(top == _TUPLES[0], _TUPLES[1]).when(top == _TUPLES[1], _TUPLES[2])
    return chain.when(top == _BRACE, _SET).when(top == _VALUE, _KEY).otherwise(top)


def _nested_step(state: Column, part: Column, words: dict[str, str]) -> Column:
    """State after one part: brackets still open, finished items, the item being read, and whether all is well formed."""
    due, item, items, last = state["due"], state["item"], state["items"], state["last"]
    pushed = F.when(part == "[", _LIST_OPEN).when(part == "(", _TUPLES[0]).when(part == "{", _BRACE)
    opens, closes, comma, colon = pushed.isNotNull(), part.isin("]", ")", "}"), part == ",", part == ":"
    top, outer, inner = F.substring(due, 1, 1), F.length(due) == 1, F.length(due) > 1
    in_tuple = top.isin(*_TUPLES)
    text = part.rlike("(?s)^['\"].*['\"]$")
    word = F.element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), part)
    value = text | word.isNotNull() | part.rlike(f"^{_NUMBER}$")
    atom = F.when(text, F.when(outer, _unquote(part)).otherwise(_quoted(_unquote(part)))).otherwise(_unquote(F.coalesce(word, part)))
    complete = last.isin("text", "value")
    # Keys and members of sets cannot be lists, sets or dicts, nor tuples that hold such.
    hashed = F.substring(F.regexp_replace(due, f"^[{_TUPLES}]+", ""), 1, 1).isin(_BRACE, _SET, _KEY)
    fits = (
        F.when(due == "", part.isin("[", "(") & (last == "start"))
        .when(part == "]", (top == _LIST_OPEN))
        .when(part == ")", in_tuple)
        .when(part == "}", top.isin(_BRACE, _SET) | ((top == _VALUE) & complete) | ((top == _KEY) & (last == "comma")))
        .when(comma, complete & (top != _KEY))
        .when(colon, complete & top.isin(_BRACE, _KEY))
        # Strings that follow each other are one.
        .when(opens | value, (last.isin("start", "comma", "colon") | (text & (last == "text") & outer)) & ~(part.isin("[", "{") & hashed))
        .otherwise(False)
    )
    closed = F.when(in_tuple & (top == _TUPLES[1]) & (last == "comma"), F.rtrim(item)).otherwise(F.regexp_replace(item, ", $", ""))
    grown = (
        F.when(outer & (comma | closes), F.lit(None).cast("string"))
        .when(due == "", item)
        .when(comma, F.concat(item, F.lit(", ")))
        .when(colon, F.concat(item, F.lit(": ")))
        .when(closes, F.concat(closed, part))
        .otherwise(F.concat(F.coalesce(item, F.lit("")), F.when(opens, part).otherwise(atom)))
    )
    rest = F.substr(due, F.lit(2))
    return F.struct(
        F.when(opens, F.concat(pushed, due)).when(closes, rest).when(comma, F.concat(_after_comma(top), rest))
        .when(colon, F.concat(F.lit(_VALUE), rest)).otherwise(due).alias("due"),
        F.when(outer & (comma | closes) & item.isNotNull(), F.array_append(items, item)).otherwise(items).alias("items"),
        grown.alias("item"),
        F.when(closes, "value").when(opens, "start").when(comma, "comma").when(colon, "colon").when(text, "text").otherwise("value").alias("last"),
        (state["ok"] & F.coalesce(fits, F.lit(False))).alias("ok"),
    )


def _nested_items(c: Column, words: dict[str, str] = _PYTHON_WORDS) -> Column:
    """Items of a list or tuple literal that holds lists, tuples, dicts, sets or strings side by side; null if it is none.

    An item that is such a literal itself is shown as Python shows it; keys that repeat stay, and members of a set
    keep the order in which they are written.
    """
    start = F.struct(
        F.lit("").alias("due"), F.array().cast("array<string>").alias("items"), F.lit(None).cast("string").alias("item"),
        F.lit("start").alias("last"), F.lit(True).alias("ok"),
    )
    parts = F.regexp_extract_all(c, F.lit(_PARTS), F.lit(1))
    whole = F.aggregate(parts, start, lambda state, part: _nested_step(state, part, words), lambda s: F.when(s["ok"] & (s["due"] == ""), s["items"]))
    return F.when(c.rlike(r"(?s)^(?:\[.*\]|\(.*\))$"), whole)


def _braced(c: Column) -> Column:
    """A cell that is one dict or set literal, as its only item; null if it is none."""
    inside = _nested_items(F.concat(F.lit("["), c, F.lit(",]")))
    return F.when(c.rlike(r"(?s)^\{.*\}$"), F.when(F.size(inside) == 1, F.array(c)))


# JSON arrays that hold arrays or objects; texts with coded letters are left to the JSON reader.
_NESTED = r"(?s)^(?!.*\\u)\[.*[\[{].*\]$"


def _json_items(c: Column) -> Column:
    """Items of a JSON array as text, spelled as Python's ``str`` spells them."""

    def spell(item: Column) -> Column:
        kind = F.schema_of_variant(item)
        text = item.try_cast("string")
        return (
            F.when(kind == "VOID", F.lit("None"))
            .when(kind == "BOOLEAN", F.initcap(text))
            .otherwise(text)
        )

    items = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    return F.transform(items, spell)


_JSON_SCALAR = (
    r'(?s)^(?:-?[0-9]++(?:\.[0-9]++)?+(?:[eE][-+]?+[0-9]++)?+|true|false|null|"[^"\\]*+(?:\\.[^"\\]*+)*+")$'
)


def _json_kind(c: Column) -> Column:
    """Type of a JSON text, null for text that is not JSON.

    The parser stops after the first complete value, so the end of the text is checked too.
    """
    closed = (
        (c.startswith("[") & c.endswith("]"))
        | (c.startswith("{") & c.endswith("}"))
        | c.rlike(_JSON_SCALAR)
    )
    return F.when(closed, F.schema_of_variant(F.try_parse_json(c)))


# Cannot occur in a cell, so it joins items without touching them.
_JOINT = "\x00"


def _distinct_ci(kept: Column) -> Column:
    """First spelling of every case-insensitive value, in order."""

    def firsts(lowered: Column) -> Column:
        return F.filter(
            kept, lambda x, i: F.array_position(lowered, F.lower(x)) == i.cast("bigint") + 1
        )

    # Hash-based distinct settles the common case without comparing pairs.
    lowered = F.split(F.lower(F.array_join(kept, _JOINT)), _JOINT)
    return F.when(F.size(F.array_distinct(lowered)) == F.size(kept), kept).otherwise(
        let(F.transform(kept, F.lower), firsts)
    )


def _kept_items(items: Column) -> Column:
    return F.filter(F.transform(items, strip), lambda x: x != "")


def dedupe_ci_ordered(items: Column) -> Column:
    """Trim, drop blanks, then keep the first spelling of every case-insensitive value."""
    return let(_kept_items(items), _distinct_ci)


def _no_items() -> Column:
    return F.array().cast("array<string>")


# Cells whose form one look settles: lists of one kind of quote, and text that starts no literal.
_ALL_DOUBLE = rf'^\[\s*"[^"\\]*+"(?:\s*,\s*"[^"\\]*+")*+\s*\]$'
_ALL_SINGLE = _ALL_DOUBLE.replace('"', "'")
_PLAIN = r"^(?![\[({'\"0-9+\-]|None|True|False|null|true|false)"


def _inside(s: Column, quote: str) -> Column:
    inner = F.regexp_replace(s, rf"^\[\s*{quote}|{quote}\s*\]$", "")
    return F.split(inner, rf"{quote}\s*,\s*{quote}")


def _plain_items(s: Column) -> Column:
    # One-character separators are split without a pattern.
    return F.when(s.contains("|"), F.split(s, r"\|")).otherwise(F.split(s, ","))


def parse_categories(c: Column) -> Column:
    """Categories cell -> array of text.

    JSON array, Python list or tuple literal, then ``|`` or ``,`` separated text; any other
    complete JSON value or literal stays one item.
    """

    def other(s: Column, kind: Column) -> Column:
        return (
            F.when(kind.startswith("ARRAY"), F.when(s.rlike(_NESTED), F.coalesce(_nested_items(s, _JSON_WORDS), _json_items(s))).otherwise(_json_items(s)))
            .when(kind.isNotNull(), F.array(s))
            .when(s.rlike(_LIST) | s.rlike(_TUPLE), _literal_items(s))
            .when(s.rlike(_SCALAR) | s.rlike(_MAPPING), F.array(s))
            .otherwise(F.coalesce(_nested_items(s), _braced(s), _plain_items(s)))
        )

    s = strip(c)
    items = (
        F.when(s.rlike(_PLAIN), _plain_items(s))
        .when(s.rlike(_ALL_DOUBLE), _inside(s, '"'))
        .when(s.rlike(_ALL_SINGLE), _inside(s, "'"))
        .otherwise(let(s, lambda v: let(_json_kind(v), lambda kind: other(v, kind))))
    )
    return F.when(is_blank(c), _no_items()).otherwise(dedupe_ci_ordered(items))


def parse_list_cell(c: Column) -> Column:
    """List cell -> array of text; a single value becomes a one-item array, commas stay."""

    def items(s: Column, kind: Column) -> Column:
        scalar = F.try_variant_get(F.try_parse_json(s), "$", "string")
        nothing = F.lit(None).cast("string")
        return (
            F.when(kind.startswith("ARRAY"), F.when(s.rlike(_NESTED), F.coalesce(_nested_items(s, _JSON_WORDS), _json_items(s))).otherwise(_json_items(s)))
            .when(kind == "VOID", F.array(nothing))
            .when(kind == "BOOLEAN", F.array(F.initcap(scalar)))
            .when(kind.isNotNull(), F.array(F.coalesce(scalar, s)))
            .when(s.rlike(_LIST) | s.rlike(_TUPLE), _literal_items(s))
            .when(s == "None", F.array(nothing))
            .when(s.rlike(rf"(?s)^{_ATOM}$"), F.array(_unquote(s)))
            .otherwise(F.coalesce(_nested_items(s), F.array(s)))
        )

    parsed = let(strip(c), lambda s: let(_json_kind(s), lambda kind: items(s, kind)))
    return F.when(is_blank(c), _no_items()).otherwise(parsed)


def join_categories(items: Column) -> Column:
    return F.array_join(items, " | ")


def join_positions(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: x.cast("string")), ", ")


def join_files(items: Column) -> Column:
    return F.array_join(items, "\n")


def map_details(files: Column, positions: Column, volumes: Column) -> Column:
    """One bullet per result list: its short name, the rank there and the search volume."""

    def shown(values: Column, i: Column) -> Column:
        value = F.get(values, i).cast("string")
        return F.when(value.isNull() | (value == "NaN"), "").otherwise(value)

    def bullet(name: Column, i: Column) -> Column:
        return F.concat(
            F.lit("- "), F.split_part(name, F.lit("_@"), F.lit(1)),
            F.lit(" (#pos "), shown(positions, i),
            F.lit(", sv "), shown(volumes, i), F.lit(")"),
        )

    return F.array_join(F.transform(files, bullet), "\n")


# Longest readable merged-table name and the length of the digest that replaces it.
_NAME_LIMIT = 120
_DIGEST_LENGTH = 10


def combined_name(files: Column) -> Column:
    """Name of the merged table for an array of input file names."""
    first = F.get(files, 0)
    extension = F.when(first.contains("."), F.element_at(F.split(first, r"\."), -1)).otherwise("xlsx")
    stems = F.array_join(F.transform(files, lambda f: F.regexp_replace(f, r"\.[^.]*$", "")), "__")
    digest = F.substring(F.md5(F.array_join(files, "__")), 1, _DIGEST_LENGTH)
    short = F.concat_ws("_", F.lit("combined"), F.size(files).cast("string"), digest)
    base = F.when(F.length(stems) > _NAME_LIMIT, short).otherwise(stems)
    return F.concat(base, F.lit("."), extension)


def digest_table_name(count: int, digest: str, extension: str) -> str:
    """Name of the merged table of ``count`` inputs whose names make a digest."""
    return f"combined_{count}_{digest[:_DIGEST_LENGTH]}.{extension}"


def combined_table_name(files: list[str]) -> str:
    """Driver-side twin of :func:`combined_name`, used to choose an output path."""
    head, dot, tail = files[0].rpartition(".")
    base = "__".join(f[: f.rfind(".")] if "." in f else f for f in files)
    if len(base) > _NAME_LIMIT:
        return digest_table_name(len(files), hashlib.md5("__".join(files).encode("utf-8")).hexdigest(), tail if dot else "xlsx")
    return f"{base}.{tail if dot else 'xlsx'}"
