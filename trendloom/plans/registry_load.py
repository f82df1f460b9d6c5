"""Registered queries of the load, the published facts and the streams, each over
whole driver tables, with its DuckDB SQL (merged into ``registry``)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import plain_chunks
from ..operators import aggregate as agg
from ..operators import matching
from ..operators.paging import numbered
from ..session import scratch_path
from ..sources.catalog import Catalog
from ..sources.dictionary import any_dictionary
from ..sources.hits import write_hits
from . import api
from . import fixtures as fx
from . import oracle as osql

HALF = "1995-06-17"                      # splits the stories into an older and a newer half
REPLACED_MONTH = "1996-03"


def _database() -> str:
    return f"trendloom_{uuid.uuid4().hex[:10]}"


# ---- matching with any dictionary ----------------------------------------------------

def t7_corpus_vocabulary(spark, sf_dir):
    """T7 with every word of the documents as a keyword: a dictionary far beyond
    what may be folded into an expression."""
    docs = fx.doc_stories(spark, sf_dir)
    path = scratch_path(spark, "words")                      # the corpus is taken apart once for its words
    docs.select(F.explode(plain_chunks("title")).alias("w")).distinct().write.parquet(path)
    words = spark.read.schema("w string").parquet(path)
    dictionary = any_dictionary(words.select(F.col("w").alias("keyword"), F.lit(True).alias("include_hiring")),
                                words.select(F.col("w").alias("token"), F.col("w").alias("canonical")))
    return matching.postings(docs, "title", ("objectid", "year_month"), dictionary)


# ---- published facts -------------------------------------------------------------------

def u3_changed_documents(spark, sf_dir):
    """Facts of documents of which some had other texts, some did not exist and
    some are gone now, brought up to date by an incremental refresh."""
    docs, comments, d = fx.doc_stories(spark, sf_dir), fx.hiring_comments(spark, sf_dir), fx.doc_dictionary()
    number = F.col("objectid").cast("long") % 10
    before = docs.where(number != 5).withColumn(
        "title", F.when(number == 3, F.concat(F.lit("la de "), F.col("title"))).otherwise(F.col("title")))
    root = scratch_path(spark, "changed")
    api.refresh(before, comments, d, root)
    return api.refresh_incremental(docs.where(number != 4), comments, d, root).read("keywords")


def s9_create_tables(spark, sf_dir):
    """Stories stored through the catalog, one month of them exchanged, read by SQL."""
    catalog = Catalog(spark, scratch_path(spark, "catalog"), _database())
    catalog.create(["stories"])
    s = fx.stories(spark, sf_dir)
    month = F.col("year_month") == REPLACED_MONTH
    catalog.append("stories", s.withColumn("title", F.when(month, F.lit("outdated")).otherwise(F.col("title"))))
    catalog.replace_partitions("stories", s.where(month))
    return spark.sql(f"SELECT objectid, submission_date, created_at_i, title, author, year_month "
                     f"FROM {catalog.name('stories')}")


def a7_repeated_keys(spark, sf_dir):
    """A7 over rows whose key does repeat: lineitem by part and supplier."""
    return agg.duplicate_keys(fx.read(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


# ---- the load ----------------------------------------------------------------------------

def _hit_halves(spark, sf_dir, root):
    """Hit files of the newer, then of the older stories (and the comments)."""
    hits = fx.all_hits(spark, sf_dir)
    newer = F.col("created_at") >= HALF
    write_hits(hits.where(newer & F.array_contains("_tags", "story")), f"{root}/newer")
    write_hits(hits.where(~(newer & F.array_contains("_tags", "story"))), f"{root}/older")


def i2_load_job(spark, sf_dir):
    """Two runs of the load job, the older files second; each
    reads the files that no run has read."""
    from .load_job import LoadJob
    root = scratch_path(spark, "job")
    _hit_halves(spark, sf_dir, root)
    job = LoadJob(spark, f"{root}/store", _database())
    for half in ("newer", "older", "older"):
        job.run(f"{root}/{half}", fx.THREAD_AS_OF, authors=["user"], prefix="", exclude=[])
    return job.catalog.table("stories")


def i6_load_job_comments(spark, sf_dir):
    """The same job's comments; the threads come as story hits and
    are due at once."""
    from .load_job import LoadJob
    root = scratch_path(spark, "job-comments")
    threads = fx.hiring_threads(spark, sf_dir)
    hits = threads.select(F.col("objectid").alias("objectID"), F.col("submission_date").alias("created_at"),
                          "created_at_i", "title", "author", F.array(F.lit("story")).alias("_tags"))
    write_hits(hits, f"{root}/threads")
    write_hits(fx.all_hits(spark, sf_dir).where(F.array_contains("_tags", "comment")), f"{root}/comments")
    job = LoadJob(spark, f"{root}/store", _database())
    job.run(root, fx.THREAD_AS_OF, authors=["user"], prefix="", exclude=[])
    job.run(root, fx.THREAD_AS_OF, authors=["user"], prefix="", exclude=[])
    return job.catalog.table("hiring_comments")


def a8_quarantine(spark, sf_dir):
    """Story hits, some without id or date, loaded; those set aside by reason."""
    from .load_job import LoadJob
    root = scratch_path(spark, "job-bad")
    n = F.col("objectID").cast("long")
    hits = fx.story_hits(spark, sf_dir)
    hits = hits.select(F.when(n % 7 != 0, F.col("objectID")).alias("objectID"),
                       F.when(n % 11 != 0, F.col("created_at")).alias("created_at"),
                       "created_at_i", "title", "author", "_tags")
    write_hits(hits, f"{root}/hits")
    job = LoadJob(spark, f"{root}/store", _database())
    job.run(f"{root}/hits", fx.AS_OF)
    stored = job.catalog.table("stories").select(F.lit("stored").alias("reason"))
    return job.quarantined("stories").select("reason").union(stored).groupBy("reason").agg(F.count("*").alias("n"))


def i5_page_walk(spark, sf_dir):
    """Every story with its place and page, newest first, ties by id."""
    return numbered(fx.stories(spark, sf_dir), 1000).select("objectid", "place", "page")


# ---- streams -------------------------------------------------------------------------------

def _run(query) -> None:
    query.awaitTermination()


def r1_hit_stream(spark, sf_dir):
    """R1 over hit files: the newer half and a broken file first; then, after a
    restart, the older half and the newer one again."""
    from ..streaming.hits import ingest_hits
    root = scratch_path(spark, "r1-hits")
    hits = fx.story_hits(spark, sf_dir)
    newer = F.col("created_at") >= HALF
    write_hits(hits.where(newer), f"{root}/hits/1")
    spark.createDataFrame([('{"hits": [{"objectID": "1", "titl',), ('{"message": "too many requests"}',)],
                          "value string").coalesce(1).write.text(f"{root}/hits/broken")
    for later in ((), ((~newer, "2"), (newer, "3"))):
        for rows, name in later:
            write_hits(hits.where(rows), f"{root}/hits/{name}")
        _run(ingest_hits(spark, f"{root}/hits", f"{root}/store", f"{root}/checkpoint", tables=("stories",)))
    from ..sources.tables import read_table
    return read_table(spark, f"{root}/store/stories", "stories")


def _delivered_twice(spark, sf_dir, root, run):
    """Run a stream over the conversations' files, each twice, then restart it over
    a third copy."""
    rows = fx.read(spark, sf_dir, "conversations")
    for copies in (("a", "b"), ("c",)):
        for name in copies:
            rows.repartition(3).write.parquet(f"{root}/source/{name}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{root}/source")
        _run(run(fx.hiring_comments_of(stream)))


def r2_repeated_files(spark, sf_dir):
    """R2: comment postings of a stream that delivers every file several times."""
    from ..streaming.streams import postings_stream
    root = scratch_path(spark, "r2-twice")
    _delivered_twice(spark, sf_dir, root, lambda comments: postings_stream(
        comments, fx.doc_dictionary(), f"{root}/sink", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/sink").select("word", "objectid", "year_month")


def r3_repeated_files(spark, sf_dir):
    """Daily counts of a stream that delivers every file several times."""
    from ..streaming.streams import latest_counts, windowed_counts_stream
    root = scratch_path(spark, "r3-twice")

    def run(comments):
        facts = matching.postings(comments, "comment_text", ("objectid", "created_date"), fx.doc_dictionary(),
                                  hiring_only=True).withColumn("event_time", F.to_timestamp("created_date"))
        return windowed_counts_stream(facts, "event_time", f"{root}/sink", f"{root}/checkpoint",
                                      key=("word", "objectid"))

    _delivered_twice(spark, sf_dir, root, run)
    day = F.date_from_unix_date((F.col("window_start_s") / 86400).cast("int")).alias("day")
    return latest_counts(spark, f"{root}/sink").select(day, "word", "n")


def queries():
    return {f.__name__: f for f in (
        t7_corpus_vocabulary, u3_changed_documents, a7_repeated_keys, s9_create_tables, i2_load_job, i6_load_job_comments,
        a8_quarantine, i5_page_walk, r1_hit_stream, r2_repeated_files, r3_repeated_files)}


def oracle_sql():
    comments = osql.postings_sql(osql.HIRING_COMMENTS, ["objectid"], "comment_text", fx.doc_dictionary(),
                                 hiring_only=True, extra=["year_month", "created_date"])
    left = f"SELECT * FROM ({osql.DOC_STORIES}) d WHERE CAST(objectid AS BIGINT) % 10 <> 4"
    threads = (f"SELECT objectid FROM ({osql.HIRING_THREADS}) t WHERE author = 'user' "
               f"AND CAST(substr(submission_date, 1, 10) AS DATE) < DATE {osql.q(fx.THREAD_AS_OF)} - INTERVAL 5 DAY")
    return {
        "t7_corpus_vocabulary": f"""
WITH c AS (
  SELECT objectid, year_month, unnest({osql.chunks_sql('title')}) AS c FROM ({osql.DOC_STORIES}) d),
p AS (SELECT * FROM c WHERE NOT (contains(c, '.') OR contains(c, '/') OR contains(c, '@'))),
words AS (SELECT DISTINCT c AS word FROM p),
parts AS (SELECT objectid, year_month, unnest(string_split_regex(c, '-+')) AS c FROM p WHERE contains(c, '-'))
SELECT DISTINCT word, objectid, year_month FROM (SELECT * FROM p UNION ALL SELECT * FROM parts) x JOIN words ON c = word""",
        "u3_changed_documents": osql.postings_sql(left, ["objectid"], "title", fx.doc_dictionary(),
                                                  extra=["submission_date", "title", "year_month"]),
        "a7_repeated_keys": ("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem "
                             "GROUP BY l_partkey, l_suppkey HAVING count(*) > 1"),
        "s9_create_tables": osql.STORIES,
        "i2_load_job": osql.STORIES,
        "i6_load_job_comments": f"SELECT * FROM ({osql.HIRING_COMMENTS}) c WHERE storyid IN ({threads})",
        "a8_quarantine": """
SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'null:objectid' WHEN o_orderkey % 11 = 0 THEN 'null:submission_date'
       ELSE 'stored' END AS reason, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
        "i5_page_walk": f"""
SELECT objectid, place, (place - 1) // 1000 + 1 AS page FROM (
  SELECT objectid, row_number() OVER (ORDER BY created_at_i DESC, objectid DESC) AS place FROM ({osql.STORIES}) s) r""",
        "r1_hit_stream": osql.STORIES,
        "r2_repeated_files": f"SELECT word, objectid, year_month FROM ({comments}) k",
        "r3_repeated_files": (f"SELECT CAST(substr(created_date, 1, 10) AS DATE) AS day, word, count(*) AS n "
                              f"FROM ({comments}) k GROUP BY 1, 2"),
    }
