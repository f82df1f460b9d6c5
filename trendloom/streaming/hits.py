"""R1 over hit files: a stream of search responses into the product's tables.

New files are read as they come.  A micro-batch parses its bodies once into a staged
copy below the checkpoint; from there, in the caller's session (with adaptive
execution), unreadable bodies go to a dead-letter folder with their text and file,
rows that break a constraint to a quarantine folder with their reason, and the other
stories and comments with a new id to their tables.

Files may come in any order and as often as they like: a story is stored once, the
first delivery wins, within a batch the newest.  There is no watermark, so the
older half may follow the newer one.  A batch that was interrupted is done again
whole: appends do nothing on conflict, and dead letters and quarantined rows lie in
a folder of their stream and batch, which is written over.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..operators import quarantine
from ..operators.append import append_new
from ..operators.ingest import of_kind, to_comments, to_stories
from ..sources import files
from ..sources.hits import stream_bodies
from ..sources.tables import read_table, write_table

#: table -> (kind of hit, projection, order in which rows of one id win)
_TABLES = {"stories": ("story", to_stories, ["-created_at_i"]),
           "hiring_comments": ("comment", to_comments, ["created_date"])}


def ingest_hits(spark: SparkSession, hits_path: str, root: str, checkpoint: str, *,
                tables: tuple[str, ...] = ("stories", "hiring_comments"), multiline: bool = False,
                max_files_per_trigger: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Load the hit files below ``hits_path`` into ``<root>/<table>``; what cannot be
    loaded into ``<root>/dead_letters`` and ``<root>/quarantine/<table>``."""
    root, checkpoint = root.rstrip("/"), checkpoint.rstrip("/")
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def load(batch: DataFrame, batch_id: int) -> None:
        staging = f"{checkpoint}/staging"
        batch.write.mode("overwrite").parquet(staging)
        bodies = spark.read.schema(batch.schema).parquet(staging)
        own = f"stream={stream}/batch_id={batch_id}"
        dead = bodies.where(F.col("problem").isNotNull()).select("file", "problem", F.col("value").alias("body"))
        if not dead.isEmpty():
            dead.write.mode("overwrite").parquet(f"{root}/dead_letters/{own}")
        hits = bodies.where(F.col("problem").isNull()).select(F.explode("hits").alias("hit")).select("hit.*")
        for table in tables:
            kind, project, order = _TABLES[table]
            rows = project(of_kind(hits, kind)).withColumn(quarantine.REASON, quarantine.broken_constraint(table))
            bad = quarantine.bad(rows)
            if not bad.isEmpty():
                bad.write.mode("overwrite").parquet(f"{root}/quarantine/{table}/{own}")
            path = f"{root}/{table}"
            stored = (read_table(spark, path, table) if files.exists(spark, path)
                      else spark.createDataFrame([], schema.SCHEMAS[table]))
            fresh = append_new(stored, quarantine.good(rows), schema.KEYS[table], order, prune_on="year_month")
            write_table(fresh, path, table, mode="append")

    writer = (stream_bodies(spark, hits_path, multiline, max_files_per_trigger)
              .writeStream.foreachBatch(load).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def dead_letters(spark: SparkSession, root: str) -> DataFrame:
    """(file, problem, body) of the responses that could not be read."""
    path = f"{root.rstrip('/')}/dead_letters"
    if not files.exists(spark, path):
        return spark.createDataFrame([], "file string, problem string, body string")
    return spark.read.parquet(path).select("file", "problem", "body")


def replayed(letters: DataFrame) -> DataFrame:
    """Dead letters parsed again, for instance after a repair of their bodies."""
    from ..sources.hits import parse_bodies
    return parse_bodies(letters.select(F.col("body").alias("value"), "file"))
