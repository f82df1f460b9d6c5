"""Matching truth table (T1-T6, F10) on the real vocabulary, and the
equivalence of the map-literal and join-based matching paths."""

import pytest
from pyspark.sql import functions as F

from trendloom.functions.text import contains_word, match_words, normalize_terms
from trendloom.operators import matching
from trendloom.sources.dictionary import (Dictionary, default_dictionary, default_keyword_list,
                                          default_synonyms, effective_vocabulary)

TRUTH = [
    ("python-based", ["python"]),
    ("py-based", []),
    ("python.org", []),
    ("java/kotlin", []),
    ("node.js", []),
    ("a@python.org", []),
    ("python3.11", []),
    ("c++17", []),
    ("objective-c++", ["cpp"]),
    ("C#", ["csharp"]),
    ("F#", ["fsharp"]),
    ("K8s", ["kubernetes"]),
    ("<b>py</b>", ["python"]),
    ('<a href="https://python.org">go</a>', []),
    ("1-python", ["python"]),
    ("python python", ["python"]),
    ("java, rust", ["java", "rust"]),
    ("", []),
    ("I use Postgres and py3", ["postgresql"]),
    ("see https://example.com/python now", []),
    ("~/python and /usr/bin/python", []),
    ("Scala3 + clj", ["clojure", "scala"]),
]


@pytest.fixture(scope="module")
def dictionary(spark):
    return default_dictionary(spark)


def test_truth_table(spark, dictionary):
    df = spark.createDataFrame([(t,) for t, _ in TRUTH], "t string")
    got = [sorted(r[0]) for r in df.select(match_words("t", dictionary.synonyms)).collect()]
    assert got == [sorted(w) for _, w in TRUTH]


def test_null_text_gives_null_array(spark, dictionary):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(match_words("t", dictionary.synonyms)).first()[0] is None
    assert df.select(F.explode(match_words("t", dictionary.synonyms))).count() == 0


def test_normalize_terms_order(spark):
    df = spark.createDataFrame([("F# C# C++ f#c++",)], "t string")
    assert df.select(normalize_terms("t")).first()[0] == "fsharp csharp cpp fsharpcpp"


def test_vocabulary_facts(spark, dictionary):
    assert len(dictionary.keywords) == 40
    assert len(dictionary.synonyms) == 50
    assert len(dictionary.effective(hiring_only=True)) == 38
    assert set(dictionary.effective()) - set(dictionary.effective(True)) == {"chatgpt", "bitcoin"}
    assert dictionary.dropped_keywords() == []
    assert set(dictionary.synonyms.values()) == set(dictionary.effective().values())


def test_effective_vocabulary_frame_drops_unknown(spark):
    kw = spark.createDataFrame([("the", "The", True, None), ("orphan", "Orphan", True, None)],
                               "keyword string, display_name string, include_hiring boolean, image_path string")
    syn = spark.createDataFrame([("the", "the"), ("der", "de")], "token string, canonical string")
    assert [r.keyword for r in effective_vocabulary(kw, syn).collect()] == ["the"]


def test_contains_word(spark, dictionary):
    df = spark.createDataFrame([("I like py",), ("nothing here",), (None,)], "t string")
    got = [r[0] for r in df.select(contains_word("t", "python", dictionary.synonyms)).collect()]
    assert got == [True, False, False]
    assert df.select(contains_word("t", "cobol", dictionary.synonyms)).first()[0] is False


def test_keyword_through_dictionary(spark):
    # a keyword that is itself an alias matches documents with the canonical word
    d = Dictionary.of({"python": "python", "py": "python"}, {"py": True})
    docs = spark.createDataFrame([("1", "python rocks"), ("2", "nothing")], "objectid string, title string")
    out = matching.postings(docs, "title", ("objectid",), d).collect()
    assert [(r.word, r.objectid) for r in out] == [("py", "1")]


def test_join_path_equals_map_path(spark):
    from tests.conftest import SF_SMALL
    from trendloom.plans import fixtures as fx
    docs = fx.doc_stories(spark, SF_SMALL)
    d = fx.doc_dictionary()
    kw = spark.createDataFrame([(k, inc) for k, inc in fx.DOC_KEYWORDS.items()],
                               "keyword string, include_hiring boolean")
    syn = spark.createDataFrame(sorted(fx.DOC_SYNONYMS.items()), "token string, canonical string")
    a = matching.postings(docs, "title", ("objectid", "year_month"), d)
    b = matching.postings_by_join(docs, "title", ("objectid", "year_month"), kw, syn)
    assert a.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_postings_unique_per_word_and_document(spark):
    from tests.conftest import SF_SMALL
    from trendloom.operators.aggregate import duplicate_keys
    from trendloom.plans import fixtures as fx
    facts = matching.story_postings(fx.doc_stories(spark, SF_SMALL), fx.doc_dictionary())
    assert duplicate_keys(facts, ["word", "objectid"]).count() == 0


def test_default_vocabulary_frames(spark):
    assert default_keyword_list(spark).count() == 40
    assert default_synonyms(spark).count() == 50


def test_path_selection_by_dictionary_size(spark, monkeypatch):
    from trendloom.sources import dictionary as dmod
    docs = spark.createDataFrame([("1", "python and k8s"), ("2", "nothing")], "objectid string, title string")
    kw = spark.createDataFrame([("python", True), ("kubernetes", True)], "keyword string, include_hiring boolean")
    syn = spark.createDataFrame([("python", "python"), ("k8s", "kubernetes"), ("kubernetes", "kubernetes")],
                                "token string, canonical string")
    want = [("kubernetes", "1"), ("python", "1")]
    used = []
    real_join = matching.postings_by_join
    monkeypatch.setattr(matching, "postings_by_join",
                        lambda *a, **k: used.append("join") or real_join(*a, **k))
    small = matching.postings_for(docs, "title", ("objectid",), kw, syn)
    assert sorted(tuple(r) for r in small.collect()) == want and used == []
    monkeypatch.setattr(dmod, "MAP_LIMIT", 2)     # 3 synonym rows: over the bound
    big = matching.postings_for(docs, "title", ("objectid",), kw, syn)
    assert sorted(tuple(r) for r in big.collect()) == want and used == ["join"]
