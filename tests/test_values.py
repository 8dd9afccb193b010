"""Scalar rules on hand-written values."""

from pyspark.sql import functions as F

from prospectry.functions import lists, text, urls


def _map(spark, function, values, dtype="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    out = rows.select("i", function(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(out, key=lambda r: r.i)]


def test_parse_categories(spark):
    cases = {
        None: [], "": [], " \xa0": [], '["A", "B"]': ["A", "B"], '["a, b", "A, B"]': ["a, b"], '[" x ",""]': ["x"],
        "['A', \"B's\"]": ["A", "B's"], "('A','b')": ["A", "b"], "('A',)": ["A"], "('A')": ["('A')"], "1, 2": ["1", "2"],
        '{"a":1}': ['{"a":1}'], "{'a': 1, 'b': 2}": ["{'a': 1, 'b': 2}"], "A, b, a": ["A", "b"], "A|B|a": ["A", "B"],
        "A, B | C": ["A, B", "C"], "'A, B'": ["'A, B'"], "[1, 2.5, null, true]": ["1", "2.5", "None", "True"],
        "[1.50, 2]": ["1.5", "2"], "[]": [], "[ ]": [], "()": [], "None": ["None"], "5": ["5"], "5 rooms, 2 baths": ["5 rooms", "2 baths"],
        '"x, y"': ['"x, y"'], ' "a" , "b" ': ["a", "b"], "['it\\'s', 'a\\nb']": ["it's", "a\nb"], "[A, B]": ["[A", "B]"],
        "x,,y,": ["x", "y"], "[None, True, 3]": ["None", "True", "3"], "nan": ["nan"],
        "['a', ['b', 'c']]": ["a", "['b', 'c']"], "['a', ('b',)]": ["a", "('b',)"], "['a' 'b']": ["ab"], "['a', 1e3]": ["a", "1000.0"],
        '["a", ["b", "c"], null]': ["a", "['b', 'c']", "None"], "[['a',\"b's\"], 'c',]": ["['a', \"b's\"]", "c"], "[[1, 2], [3.0,[]]]": ["[1, 2]", "[3.0, []]"],
        "(['a, b'], ('c', 'd'))": ["['a, b']", "('c', 'd')"], "['a', ['b']": ["['a'", "['b']"], "[['a'] 'b']": ["[['a'] 'b']"], "['a',, ['b']]": ["['a'", "['b']]"],
    }
    assert _map(spark, lists.parse_categories, list(cases)) == list(cases.values())


def test_parse_list_cell(spark):
    cases = {
        None: [], " ": [], "[1, 2]": ["1", "2"], "['a', 'b']": ["a", "b"], "A, b": ["A, b"], "7": ["7"], '"q"': ["q"],
        "'q, r'": ["q, r"], "(1, 'x')": ["1", "x"], "['a', ['b', 'c']]": ["a", "['b', 'c']"], "['a' 'b']": ["ab"], "[1e3, ['x']": ["[1e3, ['x']"], "None": [None], "true": ["True"],
    }
    assert _map(spark, lists.parse_list_cell, list(cases)) == list(cases.values())


def _random_value(rng, depth, hashed=False):
    """A literal's value; keys and members of sets hold nothing that can change."""
    kinds = ["text"] * 3 + ["number", "word"] + (["tuple"] if depth else []) + (["list", "dict", "set"] if depth and not hashed else [])
    kind = rng.choice(kinds)
    some = lambda: [_random_value(rng, depth - 1, hashed) for _ in range(rng.randrange(4))]
    if kind == "text":
        return "".join(rng.choice("abé '\",[]{}():|\\\n\t1") for _ in range(rng.randrange(6)))
    if kind == "number":
        return rng.choice([rng.randrange(-99, 9999), rng.randrange(-400, 400) / 4])
    if kind == "word":
        return rng.choice([None, True, False])
    if kind == "dict":
        return {_random_value(rng, depth - 1, True): _random_value(rng, depth - 1) for _ in range(rng.randrange(3))}
    if kind == "set":  # of one member, since the order of more is not fixed
        return {_random_value(rng, depth - 1, True)}
    return tuple(some()) if kind == "tuple" else some()


def _as_read(value):
    """The rule for a cell that is a list or tuple: texts trimmed, blank ones dropped, first spelling of each."""
    out = {}
    for item in value:
        if str(item).strip():
            out.setdefault(str(item).strip().lower(), str(item).strip())
    return list(out.values())


def test_nested_literals(spark):
    import ast
    import json
    import random

    rng = random.Random(11)
    python = [_random_value(rng, 4) for _ in range(3000)]
    python = [v for v in python if isinstance(v, (list, tuple)) and "[" in repr(v)[1:] + "{"][:700]
    spelled = [rng.choice([repr, lambda v: repr(v).replace(", ", " ,\n") if "'" not in repr(v) else repr(v)])(v) for v in python]
    assert all(ast.literal_eval(t) == v for t, v in zip(spelled, python))
    found = _map(spark, lists.parse_categories, spelled)
    assert [(t, f) for t, f, v in zip(spelled, found, python) if f != _as_read(v)] == []

    plain = lambda v: json.loads(json.dumps(v, default=list, skipkeys=True))
    nested = [plain([x for x in v if not isinstance(x, set)]) for v in python]
    texts = [json.dumps(v, ensure_ascii=False) for v in nested]
    found = _map(spark, lists.parse_categories, texts)
    assert [(t, f) for t, f, v in zip(texts, found, nested) if f != _as_read(v)] == []


def test_dicts_and_sets_in_cells(spark):
    cases = {
        "['a', {'k': 1}]": ["a", "{'k': 1}"], "[{'k': [1, (2,)], 'm': {}}, {3}]": ["{'k': [1, (2,)], 'm': {}}", "{3}"],
        '[{"k": true, "m": null}, "b"]': ["{'k': True, 'm': None}", "b"], "({'a': 1,}, {'b', })": ["{'a': 1}", "{'b'}"],
        "[({'k': 1},), 'x']": ["({'k': 1},)", "x"], "{'a': [1, 2]}": ["{'a': [1, 2]}"], "{1, (2, 3)}": ["{1, (2, 3)}"],
        # No literals: a list as a key or member, a dict without a value, a key without one, words of the other kind.
        "[{[1]: 2}|x]": ["[{[1]: 2}", "x]"], "[{[1]}, 'b']": ["[{[1]}", "'b']"], "[{'a': }, 1]": ["[{'a': }", "1]"], "[{'a': 1, 'b'}, 1]": ["[{'a': 1", "'b'}", "1]"],
        "[{'a': true}|1]": ["[{'a': true}", "1]"], "[{'a': 1: 2}|1]": ["[{'a': 1: 2}", "1]"], "{(1, [2])}|x": ["{(1, [2])}", "x"], "[{,}|1]": ["[{,}", "1]"],
    }
    assert _map(spark, lists.parse_categories, list(cases)) == list(cases.values())
    listed = {"['a', {'k': 1}]": ["a", "{'k': 1}"], "{'k': [1]}": ["{'k': [1]}"], "[{'a': }]": ["[{'a': }]"]}
    assert _map(spark, lists.parse_list_cell, list(listed)) == list(listed.values())


def test_long_numbers(spark):
    import random

    rng = random.Random(2)
    digits = ["".join(rng.choice("0123456789abcdefABCDEF") for _ in range(n)) for n in (1, 6, 7, 15, 16, 17, 18, 24, 25, 40, 300)] + ["f" * 17, "0" * 30, "0" * 20 + "1a", "1" + "0" * 18]
    assert _map(spark, urls.fid_to_cid, [f"0x1:0x{d}" for d in digits]) == [str(int(d, 16)) for d in digits]
    assert _map(spark, urls.fid_to_cid, ["0x1:0xzz", "0x1:", None]) == [None, None, None]
    assert _map(spark, text.extract_int, ["99,999,999,999 reviews", "2147483648"]) == [99_999_999_999, 2_147_483_648]


def test_query_slug(spark):
    cases = {
        "https://g.com/maps?q=a%20b": "a_b", "https://g.com/maps?query=X+Y": "x_y", "https://g.com/maps/tail?q=%20&query=z": "tail",
        "https://g.com/maps/search/x+y/@39.74,-105.05,11z": "x_y_@39_74_-105_05_11z", "https://g.com/maps/search/50%+off?hl=en": "50%_off",
        "bare tail": "bare_tail", "https://g.com/": "google maps query", "https://g.com/a?q=%252B1": "+1", "https://g.com/maps/search/a b|c": "a_b_c",
        "https://g.com/?q=&q=zz": "zz", "https://g.com/maps/search/caf%C3%A9;x": "café", "": "google maps query",
        "https://g.com/m?a=1&q=p=q#f": "p=q", "http://h/a/b/c///": "c", "https://g.com/?Q=1&query=two": "two", None: "google maps query",
        "https://g.com/maps?q=50%25+off": "50%_off", "https://g.com/maps/search/": "google maps query",
    }
    assert _map(spark, urls.query_slug, list(cases)) == list(cases.values())


def test_hosts_and_domains(spark):
    given = ["https://a.b.example.com:80/x", "shop.firm.co.uk/a", "localhost?x", "http://firm.uk", "a.me.uk", "https://x.y.ab.cd?z"]
    assert _map(spark, urls.url_host, given) == ["a.b.example.com", "shop.firm.co.uk", "localhost", "firm.uk", "a.me.uk", "x.y.ab.cd"]
    assert _map(spark, urls.root_domain, given) == ["example.com", "firm.co.uk", "localhost", "firm.uk", "a.me.uk", "y.ab.cd"]


def test_ids(spark):
    assert _map(spark, urls.fid_to_cid, ["0x1:0xffffffffffffffff", "0x1:0x1A", "0x1", None]) == ["18446744073709551615", "26", None, None]
    kinds = _map(spark, lambda c: urls.classify_place_id(c)["kind"], ["1" * 15, "1" * 16, "1" * 25, "ChIx", "/g/1", "/m/1", "g/1"])
    assert kinds == [None, "cid", None, "place_id", "kg", "kg", None]


def test_numbers(spark):
    assert _map(spark, text.extract_int, ["(1,234)", "1.2K", "none", None]) == [1234, 1, None, None]
    assert _map(spark, text.extract_float, ["4,5", "4.5 stars", "x"]) == [4.0, 4.5, None]
    assert _map(spark, lambda c: text.to_rating(c, "string"), ["4.5", " 4 ", "4.5d", "NaN", "x", None]) == [4.5, 4.0, None, None, None, None]
    assert _map(spark, text.one_decimal, [3.25, 3.75, 4.35, 0.05, 9.96, 12.0], "double") == ["3.2", "3.8", "4.3", "0.1", "10.0", "12.0"]


def test_text(spark):
    assert _map(spark, text.clean_text, ["  a \xa0\n b ", "   ", None]) == ["a b", None, None]
    assert _map(spark, text.latest_year, ["20231 and 2019", "1999", None]) == [2023, None, None]
    assert _map(spark, text.has_updated_phrase, ["Updated on March 2024", "updated: 2023", "up 2020", None]) == [True, True, False, False]
    assert _map(spark, text.count_words, ["Été naïve x_1 foo", "", None]) == [4, 0, 0]
    assert _map(spark, text.is_noise_category, ["GMB Cat.:", "Find  more", "Roofer"]) == [True, True, False]


def test_combined_name_twins(spark):
    for files in (["a.b.csv", "c"], ["a" * 130 + ".csv", "c.csv"], ["plain", "x.json"]):
        column = lists.combined_name(F.array(*[F.lit(f) for f in files]))
        assert spark.range(1).select(column.alias("n")).first().n == lists.combined_table_name(files)


def test_links(spark):
    base = F.lit("http://a.example.com")
    given = ["/x.css", "x.css", "../x.css", "//cdn.example.com/x.css", "https://b.example.com/x.css", "./y/x.css"]
    assert _map(spark, lambda c: urls.resolve_href(base, c), given) == [
        "http://a.example.com/x.css", "http://a.example.com/x.css", "http://a.example.com/x.css",
        "http://cdn.example.com/x.css", "https://b.example.com/x.css", "http://a.example.com/y/x.css",
    ]
