"""Pages of the newest rows, without a lost tie.

The order is total: newest first by time, then by descending id.  A cursor is the
pair (time, id) of a page's last row, and the next page is what lies strictly after
it in that order, so rows that share a second are never skipped between pages.

``numbered`` gives every row of a table its place and page at once: a range
partitioning in that order, then counts per partition summed over the partitions
before.  Each task numbers its own range; no task sees the whole table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

PAGE_SIZE = 1000


@dataclass(frozen=True)
class Cursor:
    """The last row that has been seen."""

    time: int
    id: str


def _order(ts_col: str, id_col: str) -> list[Column]:
    return [F.desc(ts_col), F.desc(id_col)]


def after(cursor: Cursor | None, ts_col: str = "created_at_i", id_col: str = "objectid") -> Column:
    """Rows beyond the cursor; its first part alone is a filter that scans can push down."""
    if cursor is None:
        return F.lit(True)
    older = F.col(ts_col) < F.lit(cursor.time)
    tie = (F.col(ts_col) == F.lit(cursor.time)) & (F.col(id_col) < F.lit(cursor.id))
    return (F.col(ts_col) <= F.lit(cursor.time)) & (older | tie)


def page(rows: DataFrame, cursor: Cursor | None = None, size: int = PAGE_SIZE,
         ts_col: str = "created_at_i", id_col: str = "objectid") -> DataFrame:
    """The ``size`` newest rows beyond the cursor (top-k, no global sort)."""
    return rows.where(after(cursor, ts_col, id_col)).orderBy(*_order(ts_col, id_col)).limit(size)


def cursor_of(rows: DataFrame, ts_col: str = "created_at_i", id_col: str = "objectid") -> Cursor | None:
    """The cursor after a page: its last row; None for an empty page, the end."""
    last = rows.agg(F.min(F.struct(F.col(ts_col).alias("time"), F.col(id_col).alias("id"))).alias("last")).first()["last"]
    return None if last is None else Cursor(last["time"], last["id"])


def numbered(rows: DataFrame, size: int = PAGE_SIZE, ts_col: str = "created_at_i",
             id_col: str = "objectid") -> DataFrame:
    """All rows with ``place`` (from 1, newest first) and ``page`` (from 1)."""
    spark = rows.sparkSession
    path = scratch_path(spark, "pages")
    order = _order(ts_col, id_col)
    (rows.repartitionByRange(*order).sortWithinPartitions(*order)
     .withColumn("_at", F.monotonically_increasing_id()).write.parquet(path))
    placed = spark.read.parquet(path).withColumn("_part", F.shiftrightunsigned("_at", 33))
    counts = placed.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_at") - F.col("_first") + F.col("_before")
    return (placed.join(F.broadcast(starts), "_part")
            .withColumn("place", place + 1).withColumn("page", F.floor(place / F.lit(size)) + 1)
            .select(*rows.columns, "place", "page"))
