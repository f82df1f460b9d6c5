"""The whole recurring load as one job over catalog tables.

``LoadJob.run`` reads the hit files that no earlier run has read, once:

1. stories  -> checked -> those with a new id appended to ``stories``
2. comments -> checked -> kept as *landed* until their thread is due
3. the files are marked as read
4. settled hiring threads that the log does not hold: their landed comments with a
   new id appended to ``hiring_comments``, then the threads logged

Rows that break a constraint go to a quarantine folder with their reason; nothing is
dropped without a trace.  Every step may run again: appends do nothing on conflict,
landed and quarantined rows lie in folders named by the set of files they came from,
and files and threads are marked last.  Of rows that repeat an id within a run, the
newest stays (the loader reads newest first), and a stored row is never replaced.
"""

from __future__ import annotations

import datetime as _dt
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import quarantine
from ..operators.append import append_new
from ..operators.ingest import of_kind, pending_comments, select_new, to_comments, to_stories
from ..session import scratch_path
from ..sources import files
from ..sources.catalog import Catalog
from ..sources.hits import read_hits
from ..sources.loaded_files import MANIFEST, mark_loaded, new_files
from . import api

#: The order in which rows of one id win: the loader reads newest first.
NEWEST_FIRST = {"stories": ["-created_at_i"], "hiring_comments": ["created_date"]}


class LoadJob:
    def __init__(self, spark: SparkSession, root: str, database: str | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.catalog = Catalog(spark, f"{self.root}/tables", database)
        self.catalog.create(["stories", "hiring_comments", "hiring_posts_log"])

    def run(self, hits_path: str, as_of: str | _dt.date | None = None, mode: str | None = None,
            **hiring_params) -> dict[str, int]:
        """Load what is new; ``mode`` (latest, earliest) also applies the stored
        cursor to the stories.  Returns counts of the run."""
        done = {"files": 0, "stories_bad": 0, "comments_bad": 0}
        rows = new_files(self.spark, hits_path, f"{self.root}/loaded").collect()       # of this run's files
        if rows:
            done |= self._load_files(rows, mode)
        self.catalog.log(self._process_threads(as_of, **hiring_params))
        return done

    # ---- files ---------------------------------------------------------------------

    def _load_files(self, rows: list, mode: str | None) -> dict[str, int]:
        load = hashlib.sha256("\n".join(sorted(f"{r.path} {r.modificationTime} {r.length}" for r in rows)).encode()
                              ).hexdigest()[:16]
        staged = scratch_path(self.spark, "hits")
        read_hits(self.spark, [r.path for r in rows]).write.parquet(staged)            # bodies are parsed once
        hits = self.spark.read.schema(schema.HIT).parquet(staged)
        stories, bad_stories = self._checked(to_stories(of_kind(hits, "story")), "stories", load)
        existing = self.catalog.table("stories")
        if mode:
            stories = select_new(stories, existing, mode, inclusive=True)
        self.catalog.append("stories", append_new(existing, stories, schema.KEYS["stories"], NEWEST_FIRST["stories"],
                                                  prune_on="year_month"))
        comments, bad_comments = self._checked(to_comments(of_kind(hits, "comment")), "hiring_comments", load)
        comments.write.mode("overwrite").parquet(f"{self.root}/landed/load={load}")
        mark_loaded(self.spark.createDataFrame(rows, MANIFEST), f"{self.root}/loaded")
        return {"files": len(rows), "stories_bad": bad_stories, "comments_bad": bad_comments}

    def _checked(self, rows: DataFrame, table: str, load: str) -> tuple[DataFrame, int]:
        """The good rows; the others are set aside.  One pass over ``rows``, which
        also counts."""
        path = scratch_path(self.spark, f"checked-{table}")
        marked, seen = quarantine.checked(rows, table)
        marked.write.parquet(path)
        marked = self.spark.read.schema(marked.schema).parquet(path)
        n = seen.get["bad"]
        if n:
            quarantine.bad(marked).write.mode("overwrite").parquet(f"{self.root}/quarantine/{table}/load={load}")
        return quarantine.good(marked), n

    def quarantined(self, table: str) -> DataFrame:
        """(reason, record) of the rows set aside so far."""
        path = f"{self.root}/quarantine/{table}"
        if not files.exists(self.spark, path):
            return self.spark.createDataFrame([], "reason string, record string")
        return self.spark.read.parquet(path).select("reason", "record")

    # ---- threads -------------------------------------------------------------------

    def _process_threads(self, as_of, **hiring_params) -> DataFrame:
        """Comments of the threads that are due; returns these threads, fixed once."""
        chosen = scratch_path(self.spark, "threads")
        api.unprocessed_hiring_stories(self.catalog.table("stories"), self.catalog.table("hiring_posts_log"), as_of,
                                       **hiring_params).write.parquet(chosen)
        threads = self.spark.read.schema("objectid string").parquet(chosen)
        landed = f"{self.root}/landed"
        if files.exists(self.spark, landed):
            comments = self.spark.read.schema(schema.HIRING_COMMENTS).parquet(landed)
            todo = pending_comments(comments, threads)
            self.catalog.append("hiring_comments", append_new(
                self.catalog.table("hiring_comments"), todo.select(*schema.HIRING_COMMENTS.fieldNames()),
                schema.KEYS["hiring_comments"], NEWEST_FIRST["hiring_comments"], prune_on="year_month"))
        return threads
