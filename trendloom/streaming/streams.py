"""Structured Streaming.

R1  idempotent ingest: new files -> ``foreachBatch`` append-new (S5): repeats
    within a batch and against the sink are dropped, every new key is kept
    however late it comes (no watermark, no state).  The checkpoint records
    which files were read: a restart re-reads nothing and an interrupted batch
    is redone whole.
    Over search responses: ``streaming.hits``.
R2  continuous postings: the matching expressions (T7/T8) on a streaming
    DataFrame, append to a Parquet sink partitioned by word (exactly-once file
    sink).  Documents are remembered by id in the state store, without a
    watermark: one delivered again, however late, has no facts again.
R3  windowed trend with late data: counts per (day window, word) with a
    watermark of the settling age; facts are remembered by (word, id), so repeats
    do not count.  ``update`` mode into a versioned sink whose latest version per
    key is the answer; old versions are merged level by level.  Calendar months
    are not a window length: roll days up to ``year_month`` in batch.

The memory of ids grows with the documents (a key of some ten bytes each); it lies
in RocksDB on the executors' disks with its changes in the checkpoint, not in
their heaps.  Rows that repeat an id are taken to be the same item: one of them stays.

All sinks and checkpoints live under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.append import append_new
from ..operators.matching import postings
from ..session import table_path
from ..sources import files
from ..sources.dictionary import Dictionary, DictionaryTables

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Batch versions (then merged runs of a level) that are merged into one.
FANOUT = 8
COUNTS = T.StructType([T.StructField("window_start_s", T.LongType()), T.StructField("window_end_s", T.LongType()),
                       T.StructField("word", T.StringType()), T.StructField("n", T.LongType()),
                       T.StructField("batch_id", T.LongType())])


def stream_table(spark: SparkSession, sf_dir: str, name: str,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over a table: ``<name>.parquet``, a file or a folder of files.

    The schema is taken from the existing table once (never inferred per file).
    """
    path = table_path(sf_dir, name)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if _is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _ensure_sink(spark: SparkSession, path: str, schema) -> None:
    """Create an empty sink once, so the first batch has a table to check against."""
    try:
        spark.read.schema(schema).parquet(path).inputFiles()
    except AnalysisException:  # PATH_NOT_FOUND: no sink yet
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def ingest_stream(stream: DataFrame, sink: str, checkpoint: str, key: list[str],
                  event_time: str, order: list[str] | None = None, available_now: bool = True,
                  partition_col: str | None = "event_day") -> StreamingQuery:
    """Append each new key once; ``event_time`` must be a TIMESTAMP column.

    The sink is partitioned by the UTC day of ``event_time`` (``partition_col``);
    a key's event time never changes, so the conflict check of a batch only
    reads the days the batch touches (see ``append_new(prune_on=...)``).
    """
    spark = stream.sparkSession
    out_cols = [c for c in stream.columns if c != event_time]
    rows_in = stream
    if partition_col:
        day = F.date_from_unix_date(F.floor(F.unix_seconds(F.col(event_time)) / 86400).cast("int"))
        rows_in = rows_in.withColumn(partition_col, day)
        out_cols = out_cols + [partition_col]
    sink_schema = rows_in.select(*out_cols).schema
    _ensure_sink(spark, sink, sink_schema)

    staging = f"{checkpoint.rstrip('/')}/staging"

    def _append(batch: DataFrame, batch_id: int) -> None:
        # A micro-batch runs in the stream's own session, where AQE is off (so
        # a REBALANCE would be dropped and every task would write a file per
        # day).  Stage the batch once in the shared checkpoint folder and do
        # the conflict check and the write in the caller's session; a rerun of
        # the batch simply overwrites the staging copy.
        batch.select(*out_cols).write.mode("overwrite").parquet(staging)
        rows = spark.read.schema(sink_schema).parquet(staging)
        if rows.isEmpty():
            return
        existing = spark.read.schema(sink_schema).parquet(sink)
        fresh = append_new(existing, rows, key, order, prune_on=partition_col)
        if partition_col:
            fresh = fresh.hint("rebalance", partition_col)
            fresh.write.mode("append").partitionBy(partition_col).parquet(sink)
        else:
            fresh.write.mode("append").parquet(sink)

    writer = rows_in.writeStream.foreachBatch(_append).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def _start(writer, spark: SparkSession, available_now: bool) -> StreamingQuery:
    """Start a query with its state in RocksDB; a provider that the session names
    itself is kept, and so is the one that a checkpoint was begun with."""
    key = "spark.sql.streaming.stateStore.providerClass"
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    own = "HDFSBackedStateStoreProvider" in spark.conf.get(key)          # the default
    if not own:
        return writer.start()
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)                                        # the query has a copy of the session
    try:
        return writer.start()
    finally:
        spark.conf.set(key, before)


def postings_stream(comments: DataFrame, dictionary: Dictionary | DictionaryTables, sink: str, checkpoint: str,
                    keep: tuple[str, ...] = ("objectid", "year_month"),
                    text_col: str = "comment_text", hiring_only: bool = True,
                    available_now: bool = True) -> StreamingQuery:
    """R2: postings of a comment stream, appended to a Parquet sink, each document's once.

    With a large dictionary the documents not met before are matched batch by
    batch; such a batch has a folder of its own, written over when it is repeated.
    """
    spark = comments.sparkSession
    once = comments.dropDuplicates([keep[0]])
    if isinstance(dictionary, DictionaryTables):
        def _match(batch: DataFrame, batch_id: int) -> None:
            staging = f"{checkpoint.rstrip('/')}/staging"
            batch.select(*keep, text_col).write.mode("overwrite").parquet(staging)
            rows = spark.read.schema(batch.select(*keep, text_col).schema).parquet(staging)
            (postings(rows, text_col, keep, dictionary, hiring_only)
             .write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}"))

        writer = once.writeStream.foreachBatch(_match)
    else:
        # same layout as the batch fact tables: one folder per word, so a word
        # lookup prunes to it; the file sink's log keeps the output exactly-once
        facts = postings(once, text_col, keep, dictionary, hiring_only)
        writer = facts.writeStream.format("parquet").option("path", sink).partitionBy("word").outputMode("append")
    return _start(writer.option("checkpointLocation", checkpoint), spark, available_now)


def windowed_counts_stream(facts: DataFrame, event_time: str, sink: str, checkpoint: str,
                           window: str = "1 day", watermark: str = "5 days",
                           available_now: bool = True, key: tuple[str, ...] = ()) -> StreamingQuery:
    """(window, word) counts; rows later than the watermark are dropped.

    With ``key`` (the columns that tell a fact, such as word and objectid) a fact
    counts once, however often it is delivered.  Each micro-batch writes the groups
    it updated as a run of level 0, tagged with its batch id; :func:`latest_counts`
    reads the newest version of every group.  Before that, runs of earlier batches
    are merged where ``FANOUT`` of a level have gathered (:func:`compact_counts`).
    """
    spark = facts.sparkSession
    timed = facts.withWatermark(event_time, watermark)
    counts = ((timed.dropDuplicates(list(key)) if key else timed)
              .groupBy(F.window(event_time, window).alias("w"), "word")
              .agg(F.count(F.lit(1)).alias("n")))

    def _write(batch: DataFrame, batch_id: int) -> None:
        compact_counts(spark, sink, batch_id)
        # one action per batch: the stateful aggregation must not run twice
        (batch.select(F.unix_seconds(F.col("w.start")).alias("window_start_s"),
                      F.unix_seconds(F.col("w.end")).alias("window_end_s"),
                      "word", "n", F.lit(batch_id).cast("long").alias("batch_id"))
         .write.mode("overwrite").parquet(_run(sink, 0, batch_id, batch_id)))

    writer = counts.writeStream.outputMode("update").foreachBatch(_write).option("checkpointLocation", checkpoint)
    return _start(writer, spark, available_now)


def _run(sink: str, level: int, first: int, last: int) -> str:
    return f"{sink.rstrip('/')}/level={level}/run={first:012d}-{last:012d}"


def _runs(spark: SparkSession, sink: str) -> dict[int, list[tuple[int, int]]]:
    """level -> (first batch, last batch) of its complete runs."""
    found: dict[int, list[tuple[int, int]]] = {}
    for level in (n for n in files.names(spark, sink) if n.startswith("level=")):
        for run in files.names(spark, f"{sink.rstrip('/')}/{level}"):
            if files.exists(spark, f"{sink.rstrip('/')}/{level}/{run}/_SUCCESS"):
                first, last = run.partition("=")[2].split("-")
                found.setdefault(int(level.partition("=")[2]), []).append((int(first), int(last)))
    return {k: sorted(v) for k, v in found.items()}


def _merged(runs: dict[int, list[tuple[int, int]]], level: int, run: tuple[int, int]) -> bool:
    """Whether a run of a higher level holds all batches of this one."""
    return any(lo <= run[0] and run[1] <= hi for k, v in runs.items() if k > level for lo, hi in v)


def compact_counts(spark: SparkSession, sink: str, before_batch: int, fanout: int = FANOUT) -> int:
    """Merge runs of batches before ``before_batch`` where a level holds ``fanout``
    that are not merged yet; returns how many merges were made.

    A merged run keeps the newest version of every group, with its batch id, so that
    reading it together with its parts gives the same answer: a merge that dies
    halfway, or a reader between its end and the deletion of the parts, does no
    harm.  Parts are deleted one call after their merge, which leaves readers time.
    """
    runs = _runs(spark, sink)
    for level, own in runs.items():
        for run in own:
            if _merged(runs, level, run):
                files.delete(spark, _run(sink, level, *run))
    merges = 0
    for level in sorted(runs):
        own = [r for r in runs[level] if not _merged(runs, level, r) and r[1] < before_batch]
        if len(own) < fanout:
            continue
        path = _run(sink, level + 1, own[0][0], own[-1][1])
        parts = spark.read.schema(COUNTS).parquet(*(_run(sink, level, *r) for r in own))
        merged = (parts.groupBy("window_start_s", "window_end_s", "word")
                  .agg(F.max_by("n", "batch_id").alias("n"), F.max("batch_id").alias("batch_id")))
        merged.select(*COUNTS.fieldNames()).hint("rebalance").write.mode("overwrite").parquet(path)
        runs.setdefault(level + 1, []).append((own[0][0], own[-1][1]))
        merges += 1
    return merges


def latest_counts(spark: SparkSession, sink: str) -> DataFrame:
    """R3 read side: the newest version of each (window, word) count."""
    runs = _runs(spark, sink)
    kept = [_run(sink, level, *r) for level, own in runs.items() for r in own if not _merged(runs, level, r)]
    versions = spark.read.schema(COUNTS).parquet(*kept) if kept else spark.createDataFrame([], COUNTS)
    return (versions.groupBy("window_start_s", "window_end_s", "word")
            .agg(F.max_by("n", "batch_id").alias("n")))


def monthly_rollup(daily: DataFrame) -> DataFrame:
    """R3 batch side: daily (window, word) counts rolled up to calendar months.

    ``daily`` is :func:`latest_counts` output; the month of a window is taken
    from its UTC start day, so the result does not depend on the session zone.
    """
    day = F.date_from_unix_date(F.floor(F.col("window_start_s") / 86400).cast("int"))
    return (daily.groupBy(F.date_format(day, "yyyy-MM").alias("year_month"), "word")
            .agg(F.sum("n").alias("num_occurences")))
