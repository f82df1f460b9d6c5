"""The product's own unit tests, re-expressed against the Spark operators
(range bounds, search bounds, projections, unescape, hits envelope)."""

import json

import pytest

from trendloom import schema
from trendloom.functions.predicates import bound, range_filter
from trendloom.functions.text import unescape_html
from trendloom.operators import ingest
from trendloom.sources.hits import read_hits


def _ints(spark, values):
    return spark.createDataFrame([(v,) for v in values], "created_at_i long")


def test_bound_none_value_gives_no_predicate():
    assert bound("created_at_i", "lt", None) is None


def test_bound_lt_and_gt(spark):
    df = _ints(spark, [-1, 0, 1])
    assert [r[0] for r in df.where(bound("created_at_i", "lt", 0)).collect()] == [-1]
    assert [r[0] for r in df.where(bound("created_at_i", "gt", 0)).collect()] == [1]


def test_bound_rejects_other_operators():
    with pytest.raises(ValueError):
        bound("created_at_i", "gte", 0)


def test_range_filter_combinations(spark):
    df = _ints(spark, [-1, 0, 1, 2])
    got = lambda **kw: sorted(r[0] for r in df.where(range_filter("created_at_i", **kw)).collect())
    assert got() == [-1, 0, 1, 2]
    assert got(gt=0) == [1, 2]
    assert got(lt=1) == [-1, 0]
    assert got(gt=0, lt=2) == [1]


def test_of_kind_requires_kind(spark):
    hits = spark.createDataFrame([], schema.HIT)
    with pytest.raises(ValueError):
        ingest.of_kind(hits, None)


def test_story_projection(spark):
    hits = spark.createDataFrame(
        [{"objectID": 101, "created_at": "date", "created_at_i": 1, "title": "title", "author": "author"}])
    row = ingest.to_stories(hits).first()
    assert (row.objectid, row.submission_date, row.created_at_i, row.title, row.author) == \
        ("101", "date", 1, "title", "author")


def test_unescape(spark):
    df = spark.createDataFrame([("&amp;",), ("&lt;",), (None,), ("&amp;lt;",)], "s string")
    assert [r[0] for r in df.select(unescape_html("s")).collect()] == ["&", "<", "", "&lt;"]


def test_unescape_full_is_strict(spark):
    df = spark.createDataFrame([("&eacute;t&eacute; &#233; &#xE9; &amp x &bogus;",)], "s string")
    assert df.select(unescape_html("s")).first()[0] == "été é é &amp x &bogus;"


def test_comment_projection(spark):
    hits = spark.createDataFrame([{"objectID": 101, "comment_text": "comment text", "story_id": 1,
                                   "parent_id": 2, "created_at": "date"}])
    row = ingest.to_comments(hits).first()
    assert (row.objectid, row.comment_text, row.storyid, row.parentid, row.created_date) == \
        ("101", "comment text", "1", "2", "date")
    assert row.is_toplevel_comment is False


def test_search_bounds():
    assert ingest.search_bounds("earliest", 1, None) == {"gt": None, "lt": 1}
    assert ingest.search_bounds("latest", None, 1) == {"gt": 1, "lt": None}
    assert ingest.parse_mode(None) == "latest"
    with pytest.raises(ValueError):
        ingest.parse_mode("newest")


def test_hits_envelope_two_hits(spark, tmp_dir):
    body = {"hits": [{"objectID": 1, "title": "a"}, {"objectID": "2", "title": "b"}]}
    with open(f"{tmp_dir}/page.json", "w") as fh:
        fh.write(json.dumps(body, indent=2))
    hits = read_hits(spark, tmp_dir, multiline=True)
    assert sorted(r.objectID for r in hits.collect()) == ["1", "2"]


def test_select_new_first_run_takes_everything(spark):
    incoming = _ints(spark, [5, 1, 3])
    empty = incoming.limit(0)
    for mode in ("latest", "earliest"):
        assert sorted(r[0] for r in ingest.select_new(incoming, empty, mode).collect()) == [1, 3, 5]
    existing = _ints(spark, [2, 3])
    assert sorted(r[0] for r in ingest.select_new(incoming, existing, "latest").collect()) == [5]
    assert sorted(r[0] for r in ingest.select_new(incoming, existing, "earliest").collect()) == [1]
    assert sorted(r[0] for r in ingest.select_new(incoming, existing, "latest", inclusive=True).collect()) == [3, 5]


def test_unescape_is_one_pass_over_every_reference(spark):
    rows = {"&#38;amp;": "&amp;", "&amp;lt;": "&lt;", "&notit;": "&notit;", "&eacute;&euro;": "\u00e9\u20ac",
            "&#8217;&#x1F600;": "\u2019\U0001F600", "&#128;&#xD800;": "\u20ac\ufffd", "a & b; &": "a & b; &",
            "": "", "x\n&lt;b&gt;": "x\n<b>", "&#00000000000065;&#x0000000041;": "AA", "&#0;&#x0;": "\ufffd\ufffd",
            "&#99999999;&#18446744073709551681;&#xFFFFFFFFFFFFFFFFFF;&#1114112;": "\ufffd" * 4, "&#;&#x;": "&#;&#x;",
            "&#1114111;&#x10FFFF;": "\U0010FFFF" * 2}
    df = spark.createDataFrame([(k,) for k in rows], "s string")
    assert {r.s: r.text for r in df.select("s", unescape_html("s").alias("text")).collect()} == rows


def test_matrix_columns_are_words_only(spark):
    from trendloom.operators.aggregate import wide_counts
    facts = spark.createDataFrame([("rust", "2024-01", 1)], "word string, year_month string, n int")
    assert wide_counts(facts, ["rust", ""], "n").columns == ["year_month", "rust"]
    with pytest.raises(ValueError, match="differ in case"):
        wide_counts(facts, ["rust", "Rust"], "n")
