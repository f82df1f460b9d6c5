"""One matching entry for dictionaries of any size: both forms give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.test_plans import plan
from trendloom.operators import matching
from trendloom.plans import api
from trendloom.plans import fixtures as fx
from trendloom.plans.registry_load import t7_corpus_vocabulary
from trendloom.sources import dictionary as dmod
from trendloom.sources.dictionary import Dictionary, DictionaryTables, any_dictionary, load_dictionary

KEEP = ("objectid", "year_month")


def frames(spark, keywords, synonyms):
    return (spark.createDataFrame(keywords, "keyword string, include_hiring boolean"),
            spark.createDataFrame(synonyms, "token string, canonical string"))


def both(spark, docs, keywords, synonyms, hiring=False):
    kw, syn = frames(spark, keywords, synonyms)
    small = matching.postings(docs, "title", KEEP, load_dictionary(kw, syn), hiring)
    large = matching.postings(docs, "title", KEEP, DictionaryTables(kw, syn), hiring)
    a, b = (sorted(tuple(r) for r in x.collect()) for x in (small, large))
    assert a == b
    return a


KEYWORDS = [("Python", True), ("python", False), ("K8S", True), ("c++", True), ("go", None), ("Go", True), ("nosuch", True),
            (None, True), ("python", None), ("rust-lang", True)]
SYNONYMS = [("Python", "Python"), ("py", "python"), ("K8s", "kubernetes"), ("kubernetes", "Kubernetes"), ("cpp", "cpp"),
            ("go", "go"), ("golang", "go"), ("GO", "go"), ("c++", "cpp"), ("rust-lang", "rust"), (None, "x"), ("x", None)]
DOCS = [("1", "PYTHON and py, py-based python-based", "m"), ("1", "PYTHON and py, py-based python-based", "m"),
        ("1", "K8s/kubernetes go-lang", "m"), ("2", "C++ golang GO go", "n"), ("3", None, "n"), ("4", "", "n"),
        (None, "rust-lang rust http://go.dev/go", None), ("5", "kubernetes-go-- x", "n")]


@pytest.mark.parametrize("hiring", [False, True])
def test_mixed_case_repeated_ids_and_nulls(spark, hiring):
    docs = spark.createDataFrame(DOCS, "objectid string, title string, year_month string").repartition(3)
    got = both(spark, docs.where("objectid IS NOT NULL"), KEYWORDS, SYNONYMS, hiring)
    assert got.count(("Python", "1", "m")) == 2                     # rows of one id have facts of their own
    assert ("K8S", "5", "n") in got and ("Go", "5", "n") in got and (("go", "2", "n") in got) is not hiring
    kw, syn = frames(spark, KEYWORDS, SYNONYMS)
    lone = docs.where("objectid IS NULL")
    rows = matching.postings(lone, "title", KEEP, DictionaryTables(kw, syn), hiring).collect()
    assert [(r.word, r.objectid) for r in rows] == [("rust-lang", None)]


def test_random_texts(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(rng.choice(words) + rng.choice(["", "", "-" + rng.choice(words), ".", ",", "/x"])
                            for _ in range(rng.randrange(30)))
    docs = spark.createDataFrame([(str(rng.randrange(80)), text(), "m") for _ in range(300)],
                                 "objectid string, title string, year_month string")
    syn = [(w, rng.choice(words)) for w in words[:40]] + [(w.upper(), w) for w in words[40:50]]
    assert both(spark, docs, [(w, rng.random() < 0.5) for w in words], syn)


def test_every_word_of_the_documents(spark):
    """The registered query: far more tokens than may be folded, facts unique."""
    got = t7_corpus_vocabulary(spark, SF_SMALL)
    assert got.groupBy("word", "objectid").count().where("count > 1").count() == 0 and got.count() > 10_000


def test_a_dictionary_of_the_corpus_is_read_once(spark, monkeypatch):
    """Words taken from the documents: the facts' plan takes the documents apart once
    and shuffles neither candidates nor facts where the lookup is broadcast."""
    docs = spark.createDataFrame(DOCS, "objectid string, title string, year_month string").repartition(3)
    words = docs.select(F.explode(matching.plain_chunks("title")).alias("w")).distinct()
    def facts():
        return matching.postings(docs, "title", KEEP, DictionaryTables(
            words.select(F.col("w").alias("keyword"), F.lit(True).alias("include_hiring")),
            words.select(F.col("w").alias("token"), F.col("w").alias("canonical"))))
    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=str)
    few = facts()
    p = plan(few)
    assert p.count("regexp_extract_all") == 1 and "SortMergeJoin" not in p
    assert p.count("Exchange hashpartitioning") == 1                # the filter's, a row a word of bits
    monkeypatch.setattr(matching, "MAX_BROADCAST", 0)
    monkeypatch.setattr(matching, "_may_broadcast", lambda _: False)
    many = facts()
    assert plan(many).count("regexp_extract_all") == 1
    assert rows(few) == rows(many) and ("python", "1", "m") in rows(few)


@pytest.mark.parametrize("limit", [0, 1000])
def test_tokens_and_keywords_that_share_a_word(spark, monkeypatch, limit):
    """Several tokens of a word need a distinct, several keywords a join: each alone, by either join."""
    monkeypatch.setattr(matching, "MAX_BROADCAST", limit)
    docs = spark.createDataFrame(DOCS, "objectid string, title string, year_month string").where("objectid is not null")
    assert ("Python", "1", "m") in both(spark, docs, [("Python", True)], SYNONYMS)           # one keyword, many tokens
    assert ("PY", "1", "m") in both(spark, docs, [("PY", True), ("py", True)], [("py", "python")])


def test_words_outside_the_dictionary_are_not_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([(str(i), f"rare{i} common other{i} go", "m") for i in range(200)],
                                 "objectid string, title string, year_month string")
    kw, syn = frames(spark, [("go", True)], [("go", "go")])
    monkeypatch.setattr(matching, "BLOOM_LOG2", (16, 16))
    seen = []
    real = matching.DictionaryTables.lookup
    monkeypatch.setattr(matching.DictionaryTables, "lookup", lambda *a: seen.append(1) or real(*a))
    facts = matching.postings(docs, "title", KEEP, DictionaryTables(kw, syn))
    assert facts.count() == 200
    bitmap, log2 = matching.token_bitmap(DictionaryTables(kw, syn).lookup())
    assert log2 == 16 and bitmap.count() <= 2
    p = plan(facts)
    assert p.index("BroadcastHashJoin") and "CartesianProduct" not in p and "NestedLoop" not in p


def test_a_hot_token_is_split(spark):
    """A token in every document: AQE splits its side of the join."""
    docs = spark.range(60_000).select(F.col("id").cast("string").alias("objectid"), F.lit("m").alias("year_month"),
                                      F.concat(F.lit("hot w"), (F.col("id") % 3000).cast("string")).alias("title"))
    words = spark.range(3000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("w")).union(
        spark.createDataFrame([("hot",)], "w string"))
    d = DictionaryTables(words.select(F.col("w").alias("keyword"), F.lit(True).alias("include_hiring")),
                         words.select(F.col("w").alias("token"), F.col("w").alias("canonical")))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        facts = matching.postings(docs.repartition(8), "title", KEEP, d)
        assert len(facts.collect()) == 120_000
        assert "skew=true" in plan(facts)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_refresh_takes_either_form(spark, tmp_dir, monkeypatch):
    docs, comments = fx.doc_stories(spark, SF_SMALL), fx.hiring_comments(spark, SF_SMALL)
    kw, syn = frames(spark, list(fx.DOC_KEYWORDS.items()), list(fx.DOC_SYNONYMS.items()))
    small = any_dictionary(kw, syn)
    monkeypatch.setattr(dmod, "MAP_LIMIT", 3)
    large = any_dictionary(kw, syn)
    assert isinstance(small, Dictionary) and isinstance(large, DictionaryTables)
    a = api.refresh(docs, comments, small, f"{tmp_dir}/small")
    b = api.refresh_incremental(docs, comments, large, f"{tmp_dir}/large")
    for name in ("keywords", "hiring_keywords"):
        x, y = a.read(name), b.read(name)
        assert x.count() == y.count() > 0 and x.exceptAll(y).count() == 0
    api.refresh_incremental(docs, comments, any_dictionary(kw, syn), f"{tmp_dir}/large")
    assert b.versions() == [1]                                     # the same dictionary, the same documents
    other = any_dictionary(kw, syn.union(spark.createDataFrame([("new", "the")], syn.schema)))
    api.refresh_incremental(docs, comments, other, f"{tmp_dir}/large")
    assert b.versions() == [1, 2]
