"""The merge against a plain loop over rows, and its promises under any split of the input."""

from hypothesis import HealthCheck, given, settings, strategies as s
from pyspark.sql import functions as F

from prospectry.operators import merge
from prospectry.plans.merging import merge_lists

SCHEMA = (
    "listing_link string, map_file string, position string, name string, categories array<string>, website string, phone string, "
    "address string, reviews_count int, rating double, source_file string, search_volume double, file_idx int, row_idx int"
)
FILES = ["m1", "m2", "m3"]
FIELDS = ["name", "website", "phone", "address", "reviews_count", "rating", "source_file"]


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ord", F.struct("file_idx", "row_idx"))


def _row(link, file, position, row, **more):
    values = dict(name=None, categories=None, website=None, phone=None, address=None, reviews_count=None, rating=4.5, source_file=None, search_volume=None)
    values.update(more)
    return (
        link, file, position, values["name"], values["categories"], values["website"], values["phone"], values["address"],
        values["reviews_count"], values["rating"], values["source_file"], values["search_volume"], FILES.index(file) + 1, row,
    )


def _missing(v):
    return v is None or v != v or (isinstance(v, str) and not v.strip())


def _whole(text):
    try:
        return int(text)
    except (TypeError, ValueError):
        return None


def _by_loop(rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    out = {}
    for row in sorted((dict(zip(names, r)) for r in rows), key=lambda r: (r["file_idx"], r["row_idx"])):
        if _missing(row["listing_link"]):
            continue
        got = out.setdefault(row["listing_link"], {"seen": [], "volumes": [], "categories": [], "files": set()})
        for field in FIELDS:
            if _missing(got.get(field)) and not _missing(row[field]):
                got[field] = row[field]
        got["categories"] = got["categories"] or row["categories"] or []
        got["files"].add(row["map_file"])
        place = _whole(row["position"])
        if place is not None and (row["map_file"], place) not in got["seen"]:
            got["seen"].append((row["map_file"], place))
            got["volumes"].append(row["search_volume"])
    return out


def _check(merged, rows):
    expected = _by_loop(rows)
    found = {r.listing_link: r for r in merged.collect()}
    assert found.keys() == expected.keys()
    for link, e in expected.items():
        r = found[link]
        assert list(zip(r.map_files, r.position)) == e["seen"]
        assert r.search_volume == e["volumes"]
        assert r.categories == e["categories"]
        assert {f: r[f] for f in FIELDS} == {f: e.get(f) for f in FIELDS}
        assert [r[f"query_filename{i}"] for i in (1, 2, 3)] == [f in e["files"] for f in FILES]
        assert r.status == "pending"


def test_rules(spark):
    rows = [
        _row("a", "m2", "4", 1, phone="2", categories=["late"]),
        _row("a", "m1", "3", 1, name=" ", phone="", categories=[], search_volume=7.0),
        _row("a", "m1", "3", 2, name="First", reviews_count=0, search_volume=8.0),
        _row("a", "m1", "3.0", 3, name="Second", categories=["x"]),
        _row("a", "m3", None, 1, address="only here", rating=float("nan")),
        _row(" a ", "m1", "1", 4), _row("  ", "m1", "1", 5), _row(None, "m1", "1", 6), _row("b", "m2", " 2 ", 2),
    ]
    _check(merge.merge_listings(_frame(spark, rows), FILES), rows)


def test_fractions_are_cut(spark):
    rows = _frame(spark, [_row("a", "m1", None, 1)]).withColumn("position", F.lit(3.9))
    assert merge.merge_listings(rows, FILES).first().position == [3]


_TEXT = s.sampled_from([None, "", " ", "x", "y"])
_ROWS = s.lists(
    s.tuples(
        s.sampled_from(["a", "b", " a", " ", None]), s.sampled_from(FILES), s.sampled_from(["1", "2", "2.0", None, "x"]),
        _TEXT, s.sampled_from([None, [], ["p"], ["q", "r"]]), _TEXT, _TEXT, _TEXT, s.sampled_from([None, 0, 5]),
        s.sampled_from([None, 4.2, float("nan")]), _TEXT, s.sampled_from([None, 1.0, 2.0]),
    ),
    min_size=1, max_size=25,
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=_ROWS, cut=s.integers(0, 25))
def test_any_rows_and_any_split(spark, rows, cut):
    placed = [(*r, FILES.index(r[1]) + 1, i) for i, r in enumerate(rows)]
    _check(merge.merge_listings(_frame(spark, placed), FILES), placed)
    halves = [_frame(spark, part) for part in (placed[:cut], placed[cut:])]
    partials = [merge.appearance_partials(h) for h in halves]
    _check(merge.finish_merge(merge.combine_partials(partials[1].unionByName(partials[0])), FILES), placed)


def test_repeated_input_name_keeps_last_flag(spark):
    merged = merge.merge_listings(_frame(spark, [_row("a", "m1", "1", 1)]), ["m1", "m1", "m2"]).first()
    assert [merged.query_filename1, merged.query_filename2, merged.query_filename3] == [False, True, False]


def test_job_counts_and_statuses(spark):
    rows = [
        _row("a", "m1", "1", 1, rating=4.2), _row("a ", "m1", "2", 2, rating=5.0), _row("a", "m2", "1", 1, rating=4.19),
        _row("b", "m2", "2", 2, rating=1.0), _row(None, "m2", "3", 3), _row(" NaN", "m2", "4", 4), _row("c", "m3", "1", 1, rating=float("nan")),
    ]
    result = merge_lists(_frame(spark, rows), FILES)
    assert result.summary.first().asDict() == {
        "rows_before": 7, "removed_by_rating": 3, "removed_no_link": 2, "removed_by_dedup": 1, "rows_out": 3,
    }
    statuses = {(r.file_idx, r.row_idx): r.status for r in result.sources.collect()}
    assert [k for k, v in sorted(statuses.items()) if v == "success"] == [(1, 1), (1, 2), (2, 1)]
    assert result.combined.columns[:3] == ["listing_link", "position", "name"] and result.combined.count() == 3


def test_text_ratings_are_read(spark):
    rows = spark.createDataFrame([("4.2",), ("4.19",), ("great",), (None,), ("NaN",)], "rating string")
    assert [r.rating for r in merge.filter_min_rating(rows).collect()] == ["4.2"]


def test_hot_link_stays_whole(spark):
    """One link on a third of all rows: every distinct appearance is kept, in order."""
    rows = spark.range(30000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('l', id % 500) END AS listing_link", "concat('m', 1 + id % 3) AS map_file",
        "CAST(id % 900 AS string) AS position", "concat('n', id) AS name", "array('c') AS categories", "'w' AS website", "'p' AS phone",
        "'a' AS address", "1 AS reviews_count", "4.5D AS rating", "'s' AS source_file", "1D AS search_volume", "struct(CAST(1 + id % 3 AS int) AS f, id) AS ord",
    )
    hot = merge.merge_listings(rows, FILES).where("listing_link = 'hot'").first()
    assert hot.position == list(range(0, 900, 3)) and hot.name == "n0"


def test_rank_without_a_list_counts_once(spark):
    """Such a rank is kept unless a row before it has the same rank; it brings no list and no volume."""
    rows = [_row("a", "m1", str(p), i, search_volume=7.0) for i, p in enumerate([3, 4, 3, 5])]
    rows = [(*r[:1], f, *r[2:]) for r, f in zip(rows, [None, "m1", " ", "m2"])]
    merged = merge.merge_listings(_frame(spark, rows), FILES).first()
    assert (merged.position, merged.map_files, merged.search_volume) == ([3, 4, 5], [None, "m1", "m2"], [None, 7.0, 7.0])
    after = [(*r[:1], f, *r[2:]) for r, f in zip([_row("a", "m1", "3", 0), _row("a", "m1", "3", 1)], ["m1", None])]
    assert merge.merge_listings(_frame(spark, after), FILES).first().position == [3]


def test_rows_without_a_link_are_not_joined(spark):
    rows = spark.createDataFrame([(None, 1), ("nan", 2), (" u ", 3)], "listing_link string, n int")
    links = spark.createDataFrame([("u",), ("\x00 1",)], "link string")
    assert {r.n: r.status for r in merge.mark_included(rows, links).collect()} == {1: "pending", 2: "pending", 3: "success"}


def test_sides_are_joined_on_a_column(spark):
    """The join's key is no expression, which sorting would work out again for each comparison."""
    from prospectry.operators import merge as m

    rows = spark.createDataFrame([(" a ", 1), ("a", 2), ("b", 3), (None, 4), (" ", 5), ("NaN", 6)], "listing_link string, _key int")
    links = spark.createDataFrame([("a",), ("c",)], "link string").hint("merge")
    sides = m.included_rows(rows, links), m.excluded_rows(rows, links)
    assert [sorted(r[1] for r in s.collect()) for s in sides] == [[1, 2], [3, 4, 5, 6]]
    for side in sides:
        join = next(line for line in side._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line)
        assert "SortMergeJoin [_key" in join and "CASE" not in join
