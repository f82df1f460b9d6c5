"""The recurring load, as two batch jobs over hit files.

``load_stories``          new story hits beyond the stored cursor -> stories table
``process_all_comments``  comments of every settled, unprocessed hiring thread ->
                          comments table, then the threads -> processed log

Both are re-runnable: the append does nothing on conflict, and the log is
written only after the comments, so an interrupted run re-reads its threads
and the append absorbs the repeats.  ``plans.load_job`` composes both into one job
over catalog tables that reads every file once.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession

from .. import schema
from ..operators.append import append_new
from ..operators.ingest import of_kind, pending_comments, select_new, to_comments, to_stories
from ..sources import files
from ..sources.hits import read_hits
from ..sources.tables import mark_processed, read_table, write_table
from ..session import scratch_path
from . import api


def _table_or_empty(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table, empty before the first run; one that cannot be read is an error."""
    if files.exists(spark, path):
        return read_table(spark, path, name)
    return spark.createDataFrame([], schema.SCHEMAS[name])


def load_stories(spark: SparkSession, hits_path: str, stories_path: str,
                 mode: str = "latest", inclusive: bool = False) -> DataFrame:
    """New stories of the hit files appended to the stories table, of repeated ids the
    newest; returns the table."""
    existing = _table_or_empty(spark, stories_path, "stories")
    hits = of_kind(read_hits(spark, hits_path), "story")
    incoming = select_new(to_stories(hits), existing, mode, inclusive=inclusive)
    fresh = append_new(existing, incoming, schema.KEYS["stories"], ["-created_at_i"])
    write_table(fresh, stories_path, "stories", mode="append")
    return read_table(spark, stories_path, "stories")


def process_all_comments(spark: SparkSession, hits_path: str, stories: DataFrame,
                         comments_path: str, log_path: str,
                         as_of: str | _dt.date | None = None, **hiring_params) -> DataFrame:
    """Comments of all unprocessed hiring threads appended, then the threads logged."""
    log = _table_or_empty(spark, log_path, "hiring_posts_log")
    # the list is written once: both steps below must see the same threads
    chosen = scratch_path(spark, "threads")
    api.unprocessed_hiring_stories(stories, log, as_of, **hiring_params).write.parquet(chosen)
    threads = spark.read.parquet(chosen)
    comments = to_comments(of_kind(read_hits(spark, hits_path), "comment"))
    todo = pending_comments(comments, threads)
    existing = _table_or_empty(spark, comments_path, "hiring_comments")
    fresh = append_new(existing, todo, schema.KEYS["hiring_comments"])
    write_table(fresh, comments_path, "hiring_comments", mode="append")
    mark_processed(threads, log_path)     # after the comments: a crash re-reads the thread
    return read_table(spark, comments_path, "hiring_comments")
