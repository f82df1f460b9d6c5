"""Parquet tables: schema declaration, scans and writes.

Layout: base tables partitioned by ``year_month``, fact tables by ``word``
(point lookups by word prune to one folder; ``year_month`` filters are pushed
into the row-group statistics).  Writes go through a REBALANCE on the
partition column: AQE evens out the output tasks and splits a hot word or
month over several tasks and files instead of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

MAX_RECORDS_PER_FILE = 5_000_000


def create_tables(spark: SparkSession, root: str, names=None, database: str | None = None) -> list[str]:
    """``CREATE TABLE IF NOT EXISTS ... USING parquet`` for each table,
    partitioned as in :data:`schema.PARTITION_COLUMNS`, located under ``root``.
    Returns the table names; existing tables are left as they are."""
    made, prefix = [], f"`{database}`." if database else ""
    for name in names or schema.SCHEMAS:
        st = schema.SCHEMAS[name]
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in st.fields)
        parts = schema.PARTITION_COLUMNS.get(name)
        part_sql = f" PARTITIONED BY ({', '.join(parts)})" if parts else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({cols}) USING parquet"
                  f"{part_sql} LOCATION '{root.rstrip('/')}/{name}'")
        made.append(name)
    return made


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Scan a stored table with its declared schema (no inference)."""
    return spark.read.schema(schema.SCHEMAS[name]).parquet(path).select(
        *schema.SCHEMAS[name].fieldNames())


def write_table(df: DataFrame, path: str, name: str, mode: str = "overwrite") -> None:
    """S6 (``overwrite``: full refresh) or append, partitioned and rebalanced."""
    parts = schema.PARTITION_COLUMNS.get(name, [])
    out = df.select(*schema.SCHEMAS[name].fieldNames())
    if parts:
        out = out.hint("rebalance", *parts)
    order = schema.SORT_COLUMNS.get(name, [])
    if order:
        out = out.sortWithinPartitions(*parts, *order)   # local sort, no shuffle
    (out.write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
     .partitionBy(*parts).parquet(path))


def mark_processed(ids: DataFrame, path: str) -> None:
    """Append ids to the processed log with ``processed_date`` = now."""
    (ids.select(F.col("objectid").cast("string"),
                F.current_timestamp().cast("timestamp").alias("processed_date"))
     .write.mode("append").parquet(path))


def to_records(df: DataFrame) -> DataFrame:
    """One JSON object per row (the API's list-of-records payload); a NULL
    field is kept as ``null``."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))
