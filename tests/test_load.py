"""The load job: catalog tables, files read once, quarantine, paging, order of
rows that repeat an id."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from trendloom import schema
from trendloom.operators import paging, quarantine
from trendloom.operators.append import append_new, first_per_key
from trendloom.plans import fixtures as fx
from trendloom.plans.load_job import LoadJob
from trendloom.sources import loaded_files
from trendloom.sources.catalog import Catalog
from trendloom.sources.hits import write_hits

HIT = "objectID string, created_at string, created_at_i long, title string, author string, _tags array<string>"


def hits(spark, *rows):
    return spark.createDataFrame([(i, d, s, t, "a", ["story"]) for i, d, s, t in rows], HIT)


# ---- catalog ---------------------------------------------------------------------

def story_rows(spark, *rows):
    return spark.createDataFrame([(i, f"{m}-05T00:00:00.000Z", 1, t, "a", m) for i, m, t in rows],
                                 ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.STORIES))


def test_sql_sees_rows_written_through_the_catalog(spark, tmp_dir):
    catalog = Catalog(spark, f"{tmp_dir}/tables", "catalog_test")
    assert set(catalog.create()) == set(schema.SCHEMAS)
    catalog.append("stories", story_rows(spark, ("1", "2024-01", "x"), ("2", "2024-02", "y")))
    catalog.append("stories", story_rows(spark, ("3", "2024-02", "z")))
    read = lambda: sorted(tuple(r) for r in spark.sql(
        "SELECT objectid, title, year_month FROM catalog_test.stories").collect())
    assert read() == [("1", "x", "2024-01"), ("2", "y", "2024-02"), ("3", "z", "2024-02")]
    catalog.replace_partitions("stories", story_rows(spark, ("4", "2024-02", "new"), ("5", "2024-03", "more")))
    assert read() == [("1", "x", "2024-01"), ("4", "new", "2024-02"), ("5", "more", "2024-03")]
    catalog.log(spark.createDataFrame([("1",)], "objectid string"))
    assert spark.table("catalog_test.hiring_posts_log").where("processed_date IS NOT NULL").count() == 1
    with pytest.raises(ValueError):
        catalog.replace_partitions("hiring_posts_log", spark.createDataFrame([], schema.HIRING_POSTS_LOG))
    # another session's catalog declares the same folders and finds the rows
    spark.sql("DROP DATABASE catalog_test CASCADE")
    again = Catalog(spark, f"{tmp_dir}/tables", "catalog_again")
    again.create()
    assert again.table("stories").count() == 3 and again.table("hiring_posts_log").count() == 1
    p = again.table("stories").where("year_month = '2024-02'")
    assert p.count() == 1 and "PartitionFilters: [isnotnull(year_month" in p._jdf.queryExecution().toString()


# ---- files -----------------------------------------------------------------------

def test_a_second_load_reads_only_new_files(spark, tmp_dir, monkeypatch):
    from trendloom.plans import load_job
    read = []
    real = load_job.read_hits
    monkeypatch.setattr(load_job, "read_hits", lambda s, paths: read.append(sorted(paths)) or real(s, paths))
    job = LoadJob(spark, f"{tmp_dir}/store", "files_test")
    write_hits(hits(spark, ("1", "2024-01-01", 10, "x")).coalesce(1), f"{tmp_dir}/hits/a")
    assert job.run(f"{tmp_dir}/hits")["files"] == 1
    assert job.run(f"{tmp_dir}/hits")["files"] == 0
    write_hits(hits(spark, ("2", "2024-01-02", 20, "y"), ("1", "2024-01-01", 10, "other")).coalesce(1), f"{tmp_dir}/hits/b")
    assert job.run(f"{tmp_dir}/hits")["files"] == 1
    assert [len(p) for p in read] == [1, 1] and "/hits/b/" in read[1][0]
    assert sorted((r.objectid, r.title) for r in job.catalog.table("stories").collect()) == [("1", "x"), ("2", "y")]
    listing = loaded_files.listed(spark, f"{tmp_dir}/hits")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in listing


def test_a_load_that_dies_is_done_again(spark, tmp_dir, monkeypatch):
    from trendloom.plans import load_job
    job = LoadJob(spark, f"{tmp_dir}/store", "dies_test")
    write_hits(hits(spark, ("1", "2024-01-01", 10, "x"), (None, "2024-01-01", 11, "no id")), f"{tmp_dir}/hits")

    def lost(*a):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(load_job, "mark_loaded", lost)
        job.run(f"{tmp_dir}/hits")
    done = job.run(f"{tmp_dir}/hits")
    assert done["files"] > 0 and done["stories_bad"] == 1
    assert job.catalog.table("stories").count() == 1 and job.quarantined("stories").count() == 1


# ---- constraints -----------------------------------------------------------------

def test_quarantine_gives_the_first_broken_constraint(spark, tmp_dir):
    rows = story_rows(spark, ("1", "2024-01", "x")).unionByName(spark.createDataFrame(
        [(None, "2024-01-01", 1, "t", "a", "2024-01"), ("", "2024-01-01", 1, "t", "a", "2024-01"),
         ("2", None, 1, "t", "a", None), ("3", "2024-01-01", None, None, None, "2024-01"),
         ("4", "yesterday", 1, "t", "a", "yesterd"), ("5", "2024-13-01", 1, "t", "a", "2024-13")],
        ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.STORIES)))
    marked, seen = quarantine.checked(rows, "stories")
    marked.write.parquet(f"{tmp_dir}/marked")
    assert seen.get == {"good": 1, "bad": 6}
    marked = spark.read.parquet(f"{tmp_dir}/marked")
    assert [r.objectid for r in quarantine.good(marked).collect()] == ["1"]
    bad = quarantine.bad(marked).collect()
    assert sorted(r.reason for r in bad) == ["date:submission_date", "date:submission_date", "empty:objectid",
                                             "null:created_at_i", "null:objectid", "null:submission_date"]
    assert '"title":null' in next(r.record for r in bad if r.reason == "null:created_at_i")
    # a table without rules
    assert quarantine.checked(rows.select("title"), "keyword_list")[0].where("reason IS NOT NULL").count() == 0


# ---- order -----------------------------------------------------------------------

def test_the_newest_of_a_load_wins_and_a_stored_row_stays(spark):
    rows = hits(spark, ("1", "d", 10, "old"), ("1", "d", 30, "new"), ("1", "d", 20, "mid"), ("2", "d", 5, "b"), ("2", "d", 5, "a"))
    got = {r.objectID: r.title for r in first_per_key(rows.drop("_tags"), ["objectID"], ["-created_at_i", "title"]).collect()}
    assert got == {"1": "new", "2": "a"}
    stored = hits(spark, ("1", "d", 1, "stored")).drop("_tags")
    fresh = append_new(stored, rows.drop("_tags"), ["objectID"], ["-created_at_i"])
    assert [r.objectID for r in fresh.collect()] == ["2"] and fresh.columns == stored.columns


# ---- pages -----------------------------------------------------------------------

def test_pages_lose_no_tie(spark):
    rows = spark.createDataFrame([(f"{i:03d}", 100 + i // 40) for i in range(200)], "objectid string, created_at_i long")
    seen, cursor = [], None
    while True:
        page = paging.page(rows, cursor, 30)
        got = [(r.created_at_i, r.objectid) for r in page.collect()]
        if not got:
            break
        seen += got
        cursor = paging.cursor_of(page)
    want = sorted(((100 + i // 40, f"{i:03d}") for i in range(200)), reverse=True)
    assert seen == want
    numbered = paging.numbered(rows.repartition(5), 30).collect()
    assert sorted((r.place, r.objectid) for r in numbered) == [(k + 1, i) for k, (_, i) in enumerate(want)]
    assert all(r.page == (r.place - 1) // 30 + 1 for r in numbered)
    assert paging.numbered(rows.limit(0)).count() == 0 and paging.cursor_of(rows.limit(0)) is None


def test_a_page_is_a_pushed_top_k(spark):
    stories = fx.read(spark, SF_SMALL, "lineitem").select(
        F.col("l_orderkey").alias("created_at_i"), F.col("l_partkey").alias("objectid"))
    p = paging.page(stories, paging.Cursor(500, 7), 10)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in p and "LessThanOrEqual(l_orderkey,500)" in p
