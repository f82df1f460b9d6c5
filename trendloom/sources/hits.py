"""JSON hits source (S1): search responses -> one row per hit.

A response body is an object with a ``hits`` array.  Files hold one body per
line (JSON Lines) or, with ``multiline=True``, one pretty-printed body per
file.  The schema is explicit; ids arrive as numbers or strings and are read
as strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema

PAGE_SIZE = 1000  # hits per response page
_UNREADABLE = "_unreadable"


def read_hits(spark: SparkSession, path: str | list[str], multiline: bool = False) -> DataFrame:
    """Every hit of every response file under ``path`` (or of the files listed)."""
    bodies = (spark.read.schema(schema.HITS_ENVELOPE)
              .option("multiLine", multiline).json(path))
    return bodies.select(F.explode("hits").alias("hit")).select("hit.*")


def parse_bodies(bodies: DataFrame) -> DataFrame:
    """Response bodies (``value``, ``file``) with their ``hits`` and, for those that
    hold no readable array of hits, a ``problem``.

    A body counts whole or not at all: one with a part that does not fit the schema
    is a problem, although some of its hits could be read.
    """
    envelope = T.StructType([*schema.HITS_ENVELOPE.fields, T.StructField(_UNREADABLE, T.StringType())])
    parsed = bodies.withColumn("body", F.from_json("value", envelope, {"columnNameOfCorruptRecord": _UNREADABLE}))
    problem = (F.when(F.col(f"body.{_UNREADABLE}").isNotNull(), F.lit("unreadable"))
               .when(F.col("body.hits").isNull(), F.lit("no hits")))
    return parsed.select("file", "value", problem.alias("problem"), F.col("body.hits").alias("hits"))


def stream_bodies(spark: SparkSession, path: str, multiline: bool = False,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """S1 as a file stream: one row per response body, parsed; blank lines are none.

    Files below ``path`` at any depth; a file is read once, when it first appears.
    """
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    bodies = reader.text(path, wholetext=multiline, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_bodies(bodies.where(F.trim("value") != ""))


def write_hits(hits: DataFrame, path: str, page_size: int = PAGE_SIZE) -> None:
    """Write hits as response bodies of at most ``page_size`` hits each.

    Pages are formed inside each input partition (consecutive
    ``monotonically_increasing_id`` values share a page), so no shuffle and no
    page larger than ``page_size``.
    """
    cols = [c for c in schema.HIT.fieldNames() if c in hits.columns]
    page = F.floor(F.monotonically_increasing_id() / F.lit(page_size))
    bodies = (hits.select(page.alias("_page"), F.struct(*cols).alias("hit"))
              .groupBy("_page").agg(F.collect_list("hit").alias("hits")))
    bodies.select("hits").write.mode("overwrite").json(path)
