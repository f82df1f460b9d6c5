"""The product's tables in the session's catalog.

``Catalog.create`` declares them (``CREATE TABLE IF NOT EXISTS`` over folders of a
shared root, so that a later session finds the rows again).  Writes go through the
catalog: rows are appended, or replace whole partitions (dynamic partition
overwrite: only the months in the new rows are exchanged).  SQL and
``spark.table`` see them at once.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from . import files
from .tables import create_tables


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Catalog:
    def __init__(self, spark: SparkSession, root: str, database: str | None = None):
        """Tables under ``root``, in ``database`` (the current one by default)."""
        self.spark, self.root, self.database = spark, root.rstrip("/"), database

    def name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`" if self.database else f"`{table}`"

    def create(self, tables: list[str] | None = None) -> list[str]:
        """Declare the tables that the catalog does not know; register the
        partitions that an earlier session left in their folders."""
        if self.database:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.database}` LOCATION '{self.root}/database'")
        made = create_tables(self.spark, self.root, tables, self.database)
        for table in made:
            stored = files.exists(self.spark, f"{self.root}/{table}")
            if stored and schema.PARTITION_COLUMNS.get(table) and self._tracked(table):
                self.spark.sql(f"MSCK REPAIR TABLE {self.name(table)}")
            self.spark.sql(f"REFRESH TABLE {self.name(table)}")
        return made

    def _tracked(self, table: str) -> bool:
        """Whether the catalog itself keeps the table's partitions (others list folders)."""
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name(table)}").collect()
        return any(r["col_name"] == "Partition Provider" and r["data_type"] == "Catalog" for r in rows)

    def table(self, table: str) -> DataFrame:
        """A table's rows, in the order of its declared columns."""
        return self.spark.table(self.name(table)).select(*schema.SCHEMAS[table].fieldNames())

    def _write(self, table: str, rows: DataFrame, overwrite: bool) -> None:
        parts = schema.PARTITION_COLUMNS.get(table, [])
        out = rows.select(*self.spark.table(self.name(table)).columns)      # partition columns come last there
        if parts:
            out = out.hint("rebalance", *parts).sortWithinPartitions(*parts, *schema.SORT_COLUMNS.get(table, []))
        with _setting(self.spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
            out.write.insertInto(self.name(table), overwrite=overwrite)

    def append(self, table: str, rows: DataFrame) -> None:
        self._write(table, rows, overwrite=False)

    def replace_partitions(self, table: str, rows: DataFrame) -> None:
        """Exchange the partitions that ``rows`` lie in; the others stay.  The rows
        must not be read from this table: write them elsewhere first."""
        if not schema.PARTITION_COLUMNS.get(table):
            raise ValueError(f"{table} has no partitions")
        self._write(table, rows, overwrite=True)

    def log(self, ids: DataFrame) -> None:
        """Threads processed now."""
        self.append("hiring_posts_log", ids.select(F.col("objectid").cast("string"),
                                                   F.current_timestamp().alias("processed_date")))
