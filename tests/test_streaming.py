"""Streaming semantics: late rows beyond the watermark are dropped."""

import time

from pyspark.sql import functions as F

from trendloom.sources.tables import to_records
from trendloom.streaming.streams import (ingest_stream, latest_counts, monthly_rollup, stream_table,
                                         windowed_counts_stream)


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_dir):
    schema = "word string, created_date string"
    src = f"{tmp_dir}/src"

    def run():
        facts = (spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
                 .withColumn("event_time", F.to_timestamp("created_date")))
        q = windowed_counts_stream(facts, "event_time", f"{tmp_dir}/sink", f"{tmp_dir}/ck")
        q.awaitTermination(300)

    spark.createDataFrame([("a", "2024-01-20T10:00:00.000Z"), ("a", "2024-01-20T11:00:00.000Z")],
                          schema).coalesce(1).write.parquet(f"{src}/b0")
    run()                                  # watermark: 2024-01-20 10:00 - 5 days
    spark.createDataFrame([("a", "2024-01-01T10:00:00.000Z"),    # 19 days late: dropped
                           ("a", "2024-01-19T10:00:00.000Z")],   # within 5 days: counted
                          schema).coalesce(1).write.parquet(f"{src}/b1")
    run()                                  # restart from the checkpoint: only the new file
    got = {(r.window_start_s, r.n) for r in latest_counts(spark, f"{tmp_dir}/sink").collect()}
    day = lambda d: int(time.mktime(time.strptime(d, "%Y-%m-%d"))) - time.timezone
    assert got == {(day("2024-01-20"), 2), (day("2024-01-19"), 1)}
    months = {(r.year_month, r.word, r.num_occurences)
              for r in monthly_rollup(latest_counts(spark, f"{tmp_dir}/sink")).collect()}
    assert months == {("2024-01", "a", 3)}


def _ingest(spark, src, root):
    rows = (spark.readStream.schema("id string, ts timestamp").option("recursiveFileLookup", True).parquet(src))
    q = ingest_stream(rows.withColumn("at", F.col("ts")), f"{root}/sink", f"{root}/ck", ["id"], "at")
    q.awaitTermination()
    return sorted(r.id for r in spark.read.parquet(f"{root}/sink").collect())


def test_ingest_keeps_new_keys_however_late(spark, tmp_dir):
    def write(name, *rows):
        (spark.createDataFrame(list(rows), "id string, s string").select("id", F.to_timestamp("s").alias("ts"))
         .coalesce(1).write.parquet(f"{tmp_dir}/src/{name}"))

    write("b0", ("a", "2024-01-20 10:00:00"), ("a", "2024-01-20 10:00:00"))
    assert _ingest(spark, f"{tmp_dir}/src", tmp_dir) == ["a"]
    write("b1", ("new", "2024-01-21 00:00:00"), ("old", "2024-01-01 00:00:00"), ("a", "2024-01-20 10:00:00"))
    assert _ingest(spark, f"{tmp_dir}/src", tmp_dir) == ["a", "new", "old"]


def test_stream_reads_a_table_stored_as_a_folder(spark, tmp_dir):
    spark.range(100).repartition(4).write.parquet(f"{tmp_dir}/t.parquet")
    q = (stream_table(spark, tmp_dir, "t").writeStream.format("parquet").option("path", f"{tmp_dir}/out")
         .option("checkpointLocation", f"{tmp_dir}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_dir}/out").count() == 100


def test_records_keep_null_fields(spark):
    df = spark.createDataFrame([("2019-01", None)], "ym string, title string")
    assert to_records(df).first().record == '{"ym":"2019-01","title":null}'
