"""Published versions of the fact tables (S6, U3): all tables change at once.

Data files are never changed.  A write makes a new *generation* of the months
that it touches,

    <root>/data/<table>/gen=<generation>/year_month=<month>/...

and a version is a small manifest that says which generation of each month counts:

    <root>/commits/000000000007.json
    {"dictionary": ..., "tables": {"keywords": {"year_month=2024-05": "<generation>", ...}, ...}}

The manifest is written last and whole (a rename), so a reader sees all tables of
one version or all of another; a writer that dies before leaves the current version
as it is, and its files to :meth:`FactStore.collect`.  Of two writers of the same
version one fails.  A reader may pin a version for as long as it is kept.

Rows lie sorted by word within a month, so a month's filter prunes folders and a
word's row groups, whatever the size of the dictionary.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from . import files
from .tables import MAX_RECORDS_PER_FILE

#: Digests of the documents that a version's facts stand for.
DOCUMENTS = T.StructType([T.StructField("objectid", T.StringType()), T.StructField("digest", T.LongType()),
                          T.StructField("year_month", T.StringType())])
SCHEMAS = {"keywords": schema.KEYWORDS, "hiring_keywords": schema.HIRING_KEYWORDS,
           "story_documents": DOCUMENTS, "comment_documents": DOCUMENTS}
SORTED_BY = {"keywords": ["word"], "hiring_keywords": ["word"]}
_PREFIX = "year_month="


class VersionConflict(RuntimeError):
    """Another writer has published this version."""


class FactStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- versions -----------------------------------------------------------------

    def versions(self) -> list[int]:
        """Published versions that are kept, oldest first."""
        return [int(n[:-5]) for n in files.names(self.spark, f"{self.root}/commits") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict | None:
        """What a version (the current one by default) consists of."""
        if version is None:
            version = max(self.versions(), default=None)
            if version is None:
                return None
        return json.loads(files.read_text(self.spark, self._commit(version))) | {"version": version}

    def _commit(self, version: int) -> str:
        return f"{self.root}/commits/{version:012d}.json"

    # ---- reading ------------------------------------------------------------------

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table of one version; its files are fixed when this is called."""
        found = self.manifest(version)
        months = (found or {"tables": {}})["tables"].get(table, {})
        fields = SCHEMAS[table].fieldNames()
        if not months:
            return self.spark.createDataFrame([], SCHEMAS[table])
        base = f"{self.root}/data/{table}"
        whole = T.StructType([*SCHEMAS[table].fields, T.StructField("gen", T.StringType())])
        return (self.spark.read.schema(whole).option("basePath", base)
                .parquet(*(f"{base}/gen={gen}/{month}" for month, gen in sorted(months.items()))).select(*fields))

    # ---- writing ------------------------------------------------------------------

    def begin(self) -> "Publication":
        """A new version on top of the current one."""
        return Publication(self)

    def collect(self, keep: int = 2) -> list[str]:
        """Delete the versions before the newest ``keep`` and all generations of
        months that no kept version holds; returns the folders deleted.

        A generation of a version not published yet is left alone.
        """
        kept = self.versions()[-max(1, keep):]
        if not kept:
            return []
        manifests = [self.manifest(v) for v in kept]
        for v in self.versions():
            if v < kept[0]:
                files.delete(self.spark, self._commit(v))
        gone = []
        for table in SCHEMAS:
            held = {(gen, month) for m in manifests for month, gen in m["tables"].get(table, {}).items()}
            for folder in files.names(self.spark, f"{self.root}/data/{table}"):
                gen = folder.partition("=")[2]
                if int(gen.partition("-")[0]) > kept[-1]:
                    continue
                path = f"{self.root}/data/{table}/{folder}"
                months = [n for n in files.names(self.spark, path) if n.startswith(_PREFIX)]
                free = [n for n in months if (gen, n) not in held]
                for p in [path] if len(free) == len(months) else [f"{path}/{n}" for n in free]:
                    files.delete(self.spark, p)
                    gone.append(p)
        return gone


class Publication:
    """Writes of one version; nothing of it is seen before :meth:`commit`."""

    def __init__(self, store: FactStore):
        self.store, self.spark = store, store.spark
        current = store.manifest()
        self.version = current["version"] + 1 if current else 1
        self.generation = f"{self.version:012d}-{uuid.uuid4().hex[:8]}"
        self.tables: dict[str, dict[str, str]] = {t: dict(m) for t, m in (current or {"tables": {}})["tables"].items()}

    def write(self, table: str, rows: DataFrame, months: list[str | None] | None = None) -> None:
        """Replace the given months of a table (all, if None) by ``rows``."""
        path = f"{self.store.root}/data/{table}/gen={self.generation}"
        (rows.select(*SCHEMAS[table].fieldNames()).hint("rebalance", "year_month")
         .sortWithinPartitions("year_month", *SORTED_BY.get(table, []))
         .write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
         .partitionBy("year_month").parquet(path))
        written = [n for n in files.names(self.spark, path) if n.startswith(_PREFIX)]
        replaced = None if months is None else {_folder(m) for m in months}
        kept = {} if replaced is None else {n: g for n, g in self.tables.get(table, {}).items() if n not in replaced}
        if replaced is not None and not replaced.issuperset(written):
            raise ValueError(f"rows of other months: {sorted(set(written) - replaced)}")
        self.tables[table] = kept | dict.fromkeys(written, self.generation)

    def commit(self, **facts: str) -> int:
        """Publish the version with all tables written; the others stay as they are."""
        text = json.dumps(facts | {"tables": self.tables}, sort_keys=True)
        staged = f"{self.store.root}/staged/{self.generation}.json"
        if not files.create_text(self.spark, self.store._commit(self.version), text, staged):
            raise VersionConflict(f"version {self.version} has been published by another writer")
        return self.version


def _folder(month: str | None) -> str:
    """A month's folder, as Spark names it."""
    return _PREFIX + (month if month else "__HIVE_DEFAULT_PARTITION__")


def in_months(months: list[str | None]) -> F.Column:
    """Rows of some months, null among them."""
    known = [m for m in months if m is not None]
    test = F.col("year_month").isin(known) if known else F.lit(False)
    return test | F.col("year_month").isNull() if len(known) < len(months) else test
