"""Properties of the composed queries: pivot sums, sample size,
idempotent refresh and append, vocabulary listing, schema declaration."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from trendloom import schema
from trendloom.operators import aggregate as agg
from trendloom.operators.append import append_new
from trendloom.plans import api
from trendloom.plans import fixtures as fx
from trendloom.plans import registry
from trendloom.sources.dictionary import (default_keyword_list, load_dictionary, read_keyword_list,
                                          read_synonyms)
from trendloom.sources.tables import create_tables, read_table, to_records
from trendloom import vocab


def test_parse_words():
    assert agg.parse_words("a,b,a") == ["a", "b"]
    assert agg.parse_words("") == [""]


def test_trend_matrix_sums_equal_long_counts(spark):
    long = registry.a4_story_word_counts(spark, SF_SMALL)
    wide = registry.q4_submission_trend(spark, SF_SMALL)
    words = agg.parse_words(registry.PART_TREND_WORDS)
    totals = long.groupBy("word").agg(F.sum("num_occurrences").alias("n")).collect()
    wide_sums = wide.agg(*[F.sum(w).alias(w) for w in words]).first().asDict()
    for r in totals:
        assert wide_sums[r.word] == r.n
    assert wide_sums["nosuch"] == 0
    assert wide.columns == ["year_month"] + sorted(words)


def test_trend_matrix_exact_drops_empty_words(spark):
    wide = registry.a6_trend_matrix_exact(spark, SF_SMALL)
    assert "nosuch" not in wide.columns


def test_trend_matrix_empty_words(spark):
    counts = spark.createDataFrame([], "word string, year_month string, n long")
    assert agg.trend_matrix(counts, [], "n").count() == 0


def test_running_month_excluded(spark):
    facts = spark.createDataFrame(
        [("x", "1", "t", "1998-06"), ("x", "2", "t", "1998-05"), ("x", "3", None, "1998-05")],
        "word string, objectid string, title string, year_month string")
    got = {(r.year_month, r.num_occurrences) for r in
           agg.story_word_counts(facts, ["x"], "1998-06-15").collect()}
    assert got == {("1998-05", 1)}   # count(title) skips the NULL title


def test_sample_size_and_subset(spark):
    facts = registry.doc_keywords(spark, SF_SMALL)
    point = facts.where((F.col("word") == "the")).groupBy("year_month").count().orderBy("year_month").first()
    full = facts.where((F.col("word") == "the") & (F.col("year_month") == point.year_month))
    sample = api.submission_samples(facts, "the", point.year_month, seed=7)
    rows = sample.collect()
    assert len(rows) == min(5, point["count"])
    ids = {r.objectid for r in full.collect()}
    assert {r.objectid for r in rows} <= ids
    assert sample.columns == ["title", "objectid", "submission_date"]


def test_refresh_twice_equals_once(spark, tmp_dir):
    stories, comments = fx.doc_stories(spark, SF_SMALL), fx.hiring_comments(spark, SF_SMALL)
    once = api.refresh(stories, comments, fx.doc_dictionary(), tmp_dir).read("keywords").collect()
    twice = api.refresh(stories, comments, fx.doc_dictionary(), tmp_dir).read("keywords").collect()
    assert sorted(once) == sorted(twice) and len(once) > 0


def test_append_in_two_halves_equals_at_once(spark):
    li = fx.read(spark, SF_SMALL, "lineitem")
    key = ["l_orderkey", "l_linenumber"]
    empty = li.limit(0)
    at_once = append_new(empty, li, key)
    first = append_new(empty, li.where(F.col("l_shipdate") < "1998-01-01"), key)
    second = append_new(first, li.where(F.col("l_shipdate") >= "1998-01-01"), key)
    both = first.unionByName(second)
    # same keys either way, and each key once
    assert sorted(r[0:2] for r in at_once.select(*key).collect()) == \
        sorted(r[0:2] for r in both.select(*key).collect())
    assert at_once.count() == at_once.select(*key).distinct().count()


def test_append_existing_row_wins(spark):
    existing = spark.createDataFrame([("1", "old")], "objectid string, title string")
    incoming = spark.createDataFrame([("1", "new"), ("2", "b"), ("2", "a")], "objectid string, title string")
    got = sorted(tuple(r) for r in append_new(existing, incoming, ["objectid"]).collect())
    assert got == [("2", "a")]   # first by ordering wins inside the batch


def test_keyword_listing_reads_csv(spark, tmp_dir):
    path = f"{tmp_dir}/words.csv"
    with open(path, "w") as fh:
        fh.write(vocab.KEYWORDS_CSV)
    kw = read_keyword_list(spark, path)
    assert api.keyword_listing(kw).count() == 40
    hiring = api.keyword_listing(kw, hiring=True)
    assert hiring.count() == 38
    assert hiring.columns == ["value", "display_name", "include_hiring", "image_path"]


def test_synonym_file_reader(spark, tmp_dir):
    path = f"{tmp_dir}/tech.syn"
    with open(path, "w") as fh:
        fh.write(vocab.SYNONYMS_TEXT)
    syn = read_synonyms(spark, path)
    assert syn.count() == 50
    d = load_dictionary(default_keyword_list(spark), syn)
    assert d.synonyms["k8s"] == "kubernetes"


def test_dictionary_bound_is_checked(spark):
    from trendloom.sources.dictionary import DictionaryTooLarge
    big = spark.range(30).select(F.col("id").cast("string").alias("token"),
                                 F.lit("x").alias("canonical"))
    with pytest.raises(DictionaryTooLarge):
        load_dictionary(default_keyword_list(spark), big, max_entries=10)


def test_create_tables_if_absent(spark, tmp_dir):
    made = create_tables(spark, tmp_dir)
    assert set(made) == set(schema.SCHEMAS)
    create_tables(spark, tmp_dir)  # second call is a no-op
    assert spark.table("stories").schema.fieldNames() == schema.STORIES.fieldNames()
    for name in made:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_records(spark):
    df = spark.createDataFrame([("2019-01", 3)], "year_month string, num_comments long")
    assert to_records(df).first()[0] == '{"year_month":"2019-01","num_comments":3}'


def test_hiring_view_and_sql_function(spark):
    stories = spark.createDataFrame(
        [("1", "Ask HN: Who is hiring? (May)", "whoishiring", "2020-05-01T00:00:00.000Z"),
         ("3300371", "Ask HN: Who is hiring?", "whoishiring", "2020-05-01T00:00:00.000Z"),
         ("2", "Ask HN: Who is hiring? (June)", "someone", "2020-06-01T00:00:00.000Z"),
         ("4", "ask hn: who is hiring?", None, "2020-06-01T00:00:00.000Z")],
        "objectid string, title string, author string, submission_date string")
    assert [r.objectid for r in api.hiring_stories(stories).collect()] == ["1"]
    log = spark.createDataFrame([], "objectid string")
    assert [r.objectid for r in api.unprocessed_hiring_stories(stories, log, "2020-05-05").collect()] == []
    assert [r.objectid for r in api.unprocessed_hiring_stories(stories, log, "2020-05-07").collect()] == ["1"]
    api.register_sql_functions(spark)
    assert spark.sql("SELECT normalize_terms('C# and C++') AS n").first()[0] == "csharp and cpp"


def test_streamed_postings_equal_batch(spark):
    streamed = registry.r2_stream_postings(spark, SF_SMALL)
    batch = registry.t8_comment_postings(spark, SF_SMALL)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_stream_ingest_restart_reads_nothing(spark):
    from trendloom.session import scratch_path
    from trendloom.streaming.streams import ingest_stream, stream_table
    root = scratch_path(spark, "r1-test")
    for _ in range(2):
        ev = stream_table(spark, SF_SMALL, "events").withColumn("event_time", F.col("ts").cast("timestamp"))
        q = ingest_stream(ev, f"{root}/sink", f"{root}/ck", ["event_id"], "event_time")
        q.awaitTermination(600)
    out = spark.read.parquet(f"{root}/sink")
    assert out.count() == fx.read(spark, SF_SMALL, "events").count()
    assert out.select("event_id").distinct().count() == out.count()
    # the batch is written rebalanced by day (AQE on), not one file per task and day
    days = out.select("event_day").distinct().count()
    assert len(out.inputFiles()) <= 2 * days


def test_loaders_are_rerunnable(spark, tmp_dir):
    from trendloom.plans.loader import load_stories, process_all_comments
    from trendloom.sources.hits import write_hits
    hits = f"{tmp_dir}/hits"
    write_hits(fx.all_hits(spark, SF_SMALL), hits)
    first = load_stories(spark, hits, f"{tmp_dir}/stories").count()
    again = load_stories(spark, hits, f"{tmp_dir}/stories").count()
    assert first == again == fx.stories(spark, SF_SMALL).count()
    threads = fx.hiring_threads(spark, SF_SMALL)
    args = dict(as_of=fx.THREAD_AS_OF, authors=["user"], prefix="", exclude=[])
    c1 = process_all_comments(spark, hits, threads, f"{tmp_dir}/c", f"{tmp_dir}/log", **args).count()
    c2 = process_all_comments(spark, hits, threads, f"{tmp_dir}/c", f"{tmp_dir}/log", **args).count()
    assert c1 == c2 > 0
    # every logged thread is settled, and the log has one row per thread
    log = spark.read.parquet(f"{tmp_dir}/log")
    assert log.count() == log.select("objectid").distinct().count()


def test_incremental_refresh_equals_full_and_detects_dictionary_change(spark, tmp_dir):
    from trendloom.sources.dictionary import Dictionary
    docs, comments = fx.doc_stories(spark, SF_SMALL), fx.hiring_comments(spark, SF_SMALL)
    d = fx.doc_dictionary()
    older = F.col("submission_date") < "2021-01-01"
    api.refresh_incremental(docs.where(older), comments.where(F.col("created_date") < "2021-01-01"),
                            d, f"{tmp_dir}/inc")
    api.refresh_incremental(docs, comments, d, f"{tmp_dir}/inc")
    store = api.refresh_incremental(docs, comments, d, f"{tmp_dir}/inc")   # nothing new: no change
    assert store.versions() == [1, 2]
    whole = api.refresh(docs, comments, d, f"{tmp_dir}/full")
    for name in ("keywords", "hiring_keywords"):
        inc, full = store.read(name), whole.read(name)
        assert inc.exceptAll(full).count() == 0 and full.exceptAll(inc).count() == 0
    # another dictionary: the facts are rebuilt in full with it
    d2 = Dictionary.of({"the": "the"}, {"the": True})
    store = api.refresh_incremental(docs, comments, d2, f"{tmp_dir}/inc")
    assert {r.word for r in store.read("keywords").select("word").distinct().collect()} == {"the"}


def test_incremental_refresh_recovers_from_an_interrupted_run(spark, tmp_dir, monkeypatch):
    from trendloom.sources import fact_store
    docs, comments = fx.doc_stories(spark, SF_SMALL), fx.hiring_comments(spark, SF_SMALL)
    d = fx.doc_dictionary()
    older = F.col("submission_date") < "2021-01-01"
    store = api.refresh_incremental(docs.where(older), comments.where(F.col("created_date") < "2021-01-01"),
                                    d, f"{tmp_dir}/inc")
    before = sorted(store.read("keywords").collect())

    def crash(self, **facts):
        raise RuntimeError("lost before the commit")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(fact_store.Publication, "commit", crash)
        api.refresh_incremental(docs, comments, d, f"{tmp_dir}/inc")
    assert store.versions() == [1] and sorted(store.read("keywords").collect()) == before
    inc = api.refresh_incremental(docs, comments, d, f"{tmp_dir}/inc").read("keywords")
    full = api.refresh(docs, comments, d, f"{tmp_dir}/full").read("keywords")
    assert inc.count() == full.count()
    assert inc.exceptAll(full).count() == 0 and full.exceptAll(inc).count() == 0
