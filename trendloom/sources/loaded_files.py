"""Which input files a load has read already.

The manifest is a table with a row per file and load: path, time of modification,
length.  Listing costs no reading (the ``binaryFile`` source with its content
pruned), and a file that is new, or was written again, is one that no row of the
manifest equals.  A load reads these files only, and adds them to the manifest when
its rows are stored: a load that dies before reads them again, which the append of
new keys absorbs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import files

MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
                         T.StructField("length", T.LongType())])


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length) of the files under a folder, at any depth."""
    if not files.exists(spark, folder):
        return spark.createDataFrame([], MANIFEST)
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
            .select("path", "modificationTime", "length"))


def new_files(spark: SparkSession, folder: str, manifest: str) -> DataFrame:
    """The files under ``folder`` that the manifest does not hold as they are now."""
    now = listed(spark, folder)
    if not files.exists(spark, manifest):
        return now
    known = spark.read.schema(MANIFEST).parquet(manifest)
    return now.join(known, MANIFEST.fieldNames(), "left_anti")


def mark_loaded(loaded: DataFrame, manifest: str) -> None:
    """Add files to the manifest, once their rows are stored."""
    loaded.select(*MANIFEST.fieldNames()).write.mode("append").parquet(manifest)
