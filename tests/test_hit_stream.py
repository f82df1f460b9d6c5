"""R1 over hit files; R2 and R3 under repeated deliveries; merging of R3's versions."""

import json
import os

import pytest
from pyspark.sql import functions as F

from trendloom.operators import matching
from trendloom.sources.dictionary import Dictionary, DictionaryTables
from trendloom.sources.tables import read_table
from trendloom.streaming import hits as hit_stream
from trendloom.streaming import streams

WORDS = Dictionary.of({"rust": "rust", "go": "go"}, {"rust": True, "go": True})


def story(i, second=1, title="t", date="2024-01-05T00:00:00.000Z"):
    return {"objectID": i, "created_at": date, "created_at_i": second, "title": title, "author": "a", "_tags": ["story"]}


def comment(i, text, thread="9", date="2024-02-05T00:00:00.000Z"):
    return {"objectID": i, "created_at": date, "created_at_i": 5, "comment_text": text, "story_id": thread,
            "parent_id": thread, "_tags": ["comment"]}


def body_file(folder, name, *bodies):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.write("\n".join(b if isinstance(b, str) else json.dumps({"hits": b}) for b in bodies) + "\n")


def load(spark, tmp, **options):
    hit_stream.ingest_hits(spark, f"{tmp}/hits", f"{tmp}/store", f"{tmp}/checkpoint", **options).awaitTermination()
    return sorted((r.objectid, r.title, r.created_at_i) for r in read_table(spark, f"{tmp}/store/stories", "stories").collect())


def test_older_half_second_with_repeats_and_broken_bodies(spark, tmp_dir):
    body_file(f"{tmp_dir}/hits/new", "1", [story("1", 20), story("2", 30), comment("c1", "a &amp; b")],
              '{"hits": [{"objectID": "7", ', "", '{"message": "no"}', '{"hits": [{"objectID": "8", "created_at_i": "x"}]}')
    assert load(spark, tmp_dir) == [("1", "t", 20), ("2", "t", 30)]
    body_file(f"{tmp_dir}/hits/old", "2", [story("3", 1), story("1", 20, "again"), story("1", 21)],
              [story(None), story("4", date=None), comment("c1", "other"), comment("c2", None), comment("c3", "x", None)])
    assert load(spark, tmp_dir) == [("1", "t", 20), ("2", "t", 30), ("3", "t", 1)]
    assert load(spark, tmp_dir) == [("1", "t", 20), ("2", "t", 30), ("3", "t", 1)]      # nothing new
    letters = hit_stream.dead_letters(spark, f"{tmp_dir}/store").collect()
    assert sorted(r.problem for r in letters) == ["no hits", "unreadable", "unreadable"]
    assert all("/new/1.json" in r.file for r in letters) and '{"message": "no"}' in {r.body for r in letters}
    set_aside = spark.read.parquet(f"{tmp_dir}/store/quarantine/stories")
    assert sorted(r.reason for r in set_aside.collect()) == ["null:objectid", "null:submission_date"]
    kept = read_table(spark, f"{tmp_dir}/store/hiring_comments", "hiring_comments").collect()
    assert sorted((r.objectid, r.comment_text) for r in kept) == [("c1", "a & b"), ("c2", "")]
    assert [r.reason for r in spark.read.parquet(f"{tmp_dir}/store/quarantine/hiring_comments").collect()] == ["null:storyid"]


def test_an_interrupted_batch_is_done_again(spark, tmp_dir, monkeypatch):
    body_file(f"{tmp_dir}/hits", "1", [story("1"), story(None)], "broken")
    real, calls = hit_stream.write_table, []

    def write(df, path, table, mode):
        real(df, path, table, mode)
        calls.append(table)
        if len(calls) == 1:
            raise RuntimeError("lost after the stories")

    monkeypatch.setattr(hit_stream, "write_table", write)
    with pytest.raises(Exception, match="lost after the stories"):
        load(spark, tmp_dir)
    assert load(spark, tmp_dir) == [("1", "t", 1)]
    assert hit_stream.dead_letters(spark, f"{tmp_dir}/store").count() == 1
    assert spark.read.parquet(f"{tmp_dir}/store/quarantine/stories").count() == 1


def test_whole_files_as_bodies_and_replay(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/hits")
    with open(f"{tmp_dir}/hits/a.json", "w") as f:
        json.dump({"hits": [story("1"), story("2")]}, f, indent=2)
    with open(f"{tmp_dir}/hits/b.json", "w") as f:
        f.write('{"hits": [\n{"objectID": "3"')
    assert [r[0] for r in load(spark, tmp_dir, multiline=True, tables=("stories",))] == ["1", "2"]
    letters = hit_stream.dead_letters(spark, f"{tmp_dir}/store")
    repaired = letters.withColumn("body", F.concat("body", F.lit("}]}")))
    again = hit_stream.replayed(repaired).collect()
    assert [(r.problem, r.hits[0].objectID) for r in again] == [(None, "3")]


# ---- repeats ---------------------------------------------------------------------

COMMENTS = "objectid string, comment_text string, created_date string, year_month string"
ROWS = [(str(i), ("rust", "go and rust", "none")[i % 3], f"2024-01-{1 + i % 9:02d}T10:00:00.000Z", "2024-01")
        for i in range(60)]


def deliver(spark, source, name, rows=ROWS):
    spark.createDataFrame(rows, COMMENTS).repartition(3).write.parquet(f"{source}/{name}")
    return spark.readStream.schema(COMMENTS).option("recursiveFileLookup", True).parquet(source)


@pytest.mark.parametrize("large", [False, True])
def test_postings_of_repeated_files_across_a_restart(spark, tmp_dir, large):
    dictionary = DictionaryTables(spark.createDataFrame([("Rust", True), ("go", True)], "keyword string, include_hiring boolean"),
                                  spark.createDataFrame([("rust", "rust"), ("go", "go")], "token string, canonical string")
                                  ) if large else Dictionary.of({"rust": "rust", "go": "go"}, {"Rust": True, "go": True})
    source = f"{tmp_dir}/in"
    deliver(spark, source, "a")
    for name in ("b", "c"):
        stream = deliver(spark, source, name, ROWS + [("new " + name, "go", "2020-01-01T00:00:00.000Z", "2020-01")])
        streams.postings_stream(stream, dictionary, f"{tmp_dir}/sink", f"{tmp_dir}/ck").awaitTermination()
    batch = spark.createDataFrame(ROWS + [(f"new {n}", "go", "", "2020-01") for n in "bc"], COMMENTS)
    want = matching.postings(batch, "comment_text", ("objectid", "year_month"), dictionary, True)
    got = spark.read.parquet(f"{tmp_dir}/sink").select("word", "objectid", "year_month")
    assert got.count() == want.count() == 62
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_counts_of_repeated_files_across_a_restart(spark, tmp_dir):
    source = f"{tmp_dir}/in"
    deliver(spark, source, "a")
    for name in ("b", "c"):
        stream = deliver(spark, source, name)
        facts = matching.postings(stream, "comment_text", ("objectid", "created_date"), WORDS, True)
        streams.windowed_counts_stream(facts.withColumn("at", F.to_timestamp("created_date")), "at", f"{tmp_dir}/sink",
                                       f"{tmp_dir}/ck", watermark="30 days", key=("word", "objectid")).awaitTermination()
    got = {(r.word, r.window_start_s): r.n for r in streams.latest_counts(spark, f"{tmp_dir}/sink").collect()}
    want = {}
    for i, text, date, _ in ROWS:
        for word in {"rust", "go"} & set(text.split()):
            day = int(date[8:10]) * 86400 + 1703980800            # 2023-12-31
            want[word, day] = want.get((word, day), 0) + 1
    assert got == want


def test_state_lies_in_rocksdb(spark, tmp_dir):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    stream = deliver(spark, f"{tmp_dir}/in", "a")
    streams.postings_stream(stream, WORDS, f"{tmp_dir}/sink", f"{tmp_dir}/ck").awaitTermination()
    assert spark.conf.get(key) == before
    with open(f"{tmp_dir}/ck/offsets/0") as f:
        assert "RocksDBStateStoreProvider" in f.read()


# ---- merging of versions ---------------------------------------------------------

def write_batch(spark, sink, k, words=("rust", "go")):
    rows = [(0, 86400, w, k + 1, k) for w in words] + [(86400 * k, 86400 * (k + 1), "only", k, k)]
    spark.createDataFrame(rows, streams.COUNTS).coalesce(1).write.mode("overwrite").parquet(streams._run(sink, 0, k, k))


def counts(spark, sink):
    return {(r.word, r.window_start_s): r.n for r in streams.latest_counts(spark, sink).collect()}


def test_a_hundred_batches_leave_few_files(spark, tmp_dir):
    sink = f"{tmp_dir}/sink"
    for k in range(100):
        streams.compact_counts(spark, sink, k, fanout=5)
        write_batch(spark, sink, k)
        if k in (4, 5, 6, 30, 61):
            assert counts(spark, sink) == {("rust", 0): k + 1, ("go", 0): k + 1} | {("only", 86400 * i): i for i in range(k + 1)}
    assert counts(spark, sink) == {("rust", 0): 100, ("go", 0): 100} | {("only", 86400 * i): i for i in range(100)}
    runs = streams._runs(spark, sink)
    assert sum(len(r) for r in runs.values()) <= 20 and max(runs) == 2


def test_merges_do_no_harm_when_they_die_or_batches_come_again(spark, tmp_dir):
    sink = f"{tmp_dir}/sink"
    for k in range(6):
        write_batch(spark, sink, k)
    want = counts(spark, sink)
    # a merged run without its mark of success does not count
    spark.createDataFrame([(0, 86400, "rust", 999, 99)], streams.COUNTS).write.parquet(streams._run(sink, 1, 0, 3))
    os.remove(streams._run(sink, 1, 0, 3) + "/_SUCCESS")
    assert counts(spark, sink) == want
    assert streams.compact_counts(spark, sink, 4, fanout=4) == 1
    assert counts(spark, sink) == want and (0, 3) in streams._runs(spark, sink)[1]
    assert len(streams._runs(spark, sink)[0]) == 6                 # the parts are still there for readers
    write_batch(spark, sink, 5)                                    # a batch that is done again
    assert streams.compact_counts(spark, sink, 6, fanout=4) == 0
    assert len(streams._runs(spark, sink)[0]) == 2 and counts(spark, sink) == want
    assert counts(spark, f"{tmp_dir}/nothing") == {}
