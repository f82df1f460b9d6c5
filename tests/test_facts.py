"""Published fact tables: one commit for all tables, pinned readers, old versions
collected, changed and deleted documents, pruned reads."""

import glob

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.test_plans import plan
from trendloom.plans import api, facts
from trendloom.plans import fixtures as fx
from trendloom.sources import fact_store
from trendloom.sources.dictionary import Dictionary
from trendloom.sources.fact_store import FactStore, VersionConflict

WORDS = Dictionary.of({"rust": "rust", "go": "go", "golang": "go"}, {"rust": True, "go": True})
STORY = "objectid string, submission_date string, title string, year_month string"
COMMENT = "objectid string, comment_text string, year_month string"


def stories(spark, *rows):
    return spark.createDataFrame([(i, f"{m}-01T00:00:00.000Z" if m else None, t, m) for i, m, t in rows], STORY)


def comments(spark, *rows):
    return spark.createDataFrame([(i, t, m) for i, m, t in rows], COMMENT)


def found(store, table="keywords", version=None):
    return sorted((r.word, r.objectid) for r in store.read(table, version).collect())


OLD = [("1", "2024-01", "rust"), ("2", "2024-01", "go"), ("3", "2024-02", "golang and rust"), ("4", None, "rust")]


def test_refresh_that_dies_between_the_tables_changes_nothing(spark, tmp_dir, monkeypatch):
    store = api.refresh(stories(spark, *OLD), comments(spark, ("c", "2024-01", "go")), WORDS, tmp_dir)
    before = found(store), found(store, "hiring_keywords")
    assert before[0] == [("go", "2"), ("go", "3"), ("rust", "1"), ("rust", "3"), ("rust", "4")]
    real, calls = fact_store.Publication.write, []

    def write(self, table, *args):
        calls.append(table)
        if table == "hiring_keywords":
            raise RuntimeError("lost")
        real(self, table, *args)

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(fact_store.Publication, "write", write)
        api.refresh(stories(spark, ("9", "2024-01", "go")), comments(spark), WORDS, tmp_dir)
    assert calls[0] == "keywords"                      # the first table was written
    assert (found(store), found(store, "hiring_keywords")) == before and store.versions() == [1]
    # what the dead writer left behind goes once a later version is published
    api.refresh(stories(spark, ("9", "2024-01", "go")), comments(spark), WORDS, tmp_dir)
    assert found(store) == [("go", "9")] and found(store, "hiring_keywords") == []
    assert len(glob.glob(f"{tmp_dir}/data/keywords/gen=*")) == 3
    store.collect(keep=1)
    assert len(glob.glob(f"{tmp_dir}/data/keywords/gen=*")) == 1 and found(store) == [("go", "9")]


def test_readers_are_pinned_until_collected(spark, tmp_dir):
    store = FactStore(spark, tmp_dir)
    assert found(store) == [] and store.manifest() is None and store.collect() == []
    for k in range(3):
        api.refresh(stories(spark, (str(k), "2024-01", "go")), comments(spark), WORDS, tmp_dir)
    reader = store.read("keywords", 2)
    api.refresh(stories(spark, ("3", "2024-01", "go")), comments(spark), WORDS, tmp_dir)
    assert [(r.word, r.objectid) for r in reader.collect()] == [("go", "1")]
    store.collect(keep=3)
    assert store.versions() == [2, 3, 4] and found(store, version=2) == [("go", "1")]
    store.collect()
    assert store.versions() == [3, 4] and found(store) == [("go", "3")]


def test_one_of_two_writers_of_a_version_fails(spark, tmp_dir):
    store = FactStore(spark, tmp_dir)
    a, b = store.begin(), store.begin()
    a.commit(dictionary="x")
    with pytest.raises(VersionConflict):
        b.commit(dictionary="y")
    assert store.versions() == [1] and store.manifest()["dictionary"] == "x"


def test_changed_moved_and_deleted_documents(spark, tmp_dir):
    api.refresh_incremental(stories(spark, *OLD), comments(spark, ("c", "2024-01", "go")), WORDS, tmp_dir)
    now = [("1", "2024-01", "now golang"), ("3", "2024-03", "golang and rust"), ("4", None, "rust go"),
           ("5", "2024-02", "rust"), ("6", "2024-04", "nothing")]     # 2 gone, 3 in another month, 5 and 6 new
    store = api.refresh_incremental(stories(spark, *now), comments(spark, ("c", "2024-01", "go")), WORDS, tmp_dir)
    assert found(store) == [("go", "1"), ("go", "3"), ("go", "4"), ("rust", "3"), ("rust", "4"), ("rust", "5")]
    assert found(store, "hiring_keywords") == [("go", "c")]
    assert {r.year_month for r in store.read("keywords").where("objectid = '3'").collect()} == {"2024-03"}
    # the comments' files are still those of the first version
    tables = store.manifest()["tables"]
    assert all(g.startswith("000000000001-") for g in tables["hiring_keywords"].values())
    store = api.refresh_incremental(stories(spark), comments(spark), WORDS, tmp_dir)
    assert found(store) == found(store, "hiring_keywords") == []


def test_untouched_months_are_not_written_again(spark, tmp_dir):
    rows = [(str(i), f"2024-{1 + i % 6:02d}", "rust") for i in range(30)]
    api.refresh_incremental(stories(spark, *rows), comments(spark), WORDS, tmp_dir)
    rows[7] = ("7", "2024-02", "go")
    store = api.refresh_incremental(stories(spark, *rows), comments(spark), WORDS, tmp_dir)
    new = {m for m, g in store.manifest()["tables"]["keywords"].items() if g.startswith("000000000002-")}
    assert new == {"year_month=2024-02"} and ("go", "7") in found(store) and len(found(store)) == 30


def test_incremental_refresh_matches_changed_documents_only(spark, tmp_dir, monkeypatch):
    """Matched are the changed documents; their months' folders alone are read for it."""
    docs, base = fx.doc_stories(spark, SF_SMALL), f"{tmp_dir}/docs"
    docs.write.partitionBy("year_month").parquet(base)
    docs = spark.read.parquet(base)
    none = comments(spark)
    api.refresh_incremental(docs, none, fx.doc_dictionary(), f"{tmp_dir}/facts")
    seen = []
    real = facts.story_postings
    monkeypatch.setitem(facts._CORPORA, "stories", facts._CORPORA["stories"][:2] + (
        lambda todo, d: seen.append(todo) or real(todo, d),) + facts._CORPORA["stories"][3:])
    month = docs.select("year_month").first()[0]
    one = docs.where(F.col("year_month") == month).select("objectid").first()[0]
    changed = docs.withColumn("title", F.when(F.col("objectid") == one, F.lit("the de")).otherwise(F.col("title")))
    store = api.refresh_incremental(changed, none, fx.doc_dictionary(), f"{tmp_dir}/facts")
    assert [r.objectid for r in seen[0].collect()] == [one]
    p = plan(seen[0])
    assert f"PartitionFilters: [isnotnull(year_month" in p and f"(year_month" in p and f"= {month})" in p
    assert {r.word for r in store.read("keywords").where(F.col("objectid") == one).collect()} == {"the", "de"}
