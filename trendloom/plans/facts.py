"""Refresh of the fact tables (U3, T7, T8, S6): in full, or of what changed.

Both end in one commit of a :class:`FactStore`: the story facts, the comment facts
and the digests of the documents that they stand for change together.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.matching import comment_postings, story_postings
from ..sources.fact_store import FactStore, in_months

#: corpus -> (facts, digests, matching, columns that the facts come from)
_CORPORA = {
    "stories": ("keywords", "story_documents", story_postings, ("objectid", "submission_date", "title", "year_month")),
    "comments": ("hiring_keywords", "comment_documents", comment_postings, ("objectid", "comment_text", "year_month")),
}


def _digests(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(objectid, digest, year_month); null and '' differ."""
    parts = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return docs.select("objectid", F.xxhash64(*parts).alias("digest"), "year_month")


def refresh(stories: DataFrame, comments: DataFrame, dictionary, root: str) -> FactStore:
    """Match every document and publish both fact tables as a new version."""
    store = FactStore(stories.sparkSession, root)
    new = store.begin()
    tables = []
    for docs, (facts, digests, match, columns) in zip((stories, comments), _CORPORA.values()):
        tables += [(facts, match(docs, dictionary)), (digests, _digests(docs, columns))]
    with ThreadPoolExecutor(len(tables)) as pool:         # the tables' jobs share the cluster
        for done in [pool.submit(new.write, name, rows) for name, rows in tables]:
            done.result()
    new.commit(dictionary=dictionary.fingerprint())
    return store


def _by_id(digests: DataFrame) -> DataFrame:
    """What tells an id's rows: how many, and the sum of their digests."""
    return digests.groupBy("objectid").agg(F.count("*").alias("n"),
                                           F.sum(F.col("digest").cast("decimal(38,0)")).alias("sum"))


def _changed_months(now: DataFrame, stored: DataFrame) -> list[str | None]:
    """Months whose documents differ: count and sum of digests, a row a month."""
    def sums(rows: DataFrame, name: str) -> DataFrame:
        mark = F.xxhash64("objectid", "digest").cast("decimal(38,0)")
        return rows.groupBy("year_month").agg(F.struct(F.count("*").alias("n"), F.sum(mark).alias("sum")).alias(name))

    a, b = sums(now, "a"), sums(stored, "b").withColumnRenamed("year_month", "stored_month")
    both = a.join(b, a["year_month"].eqNullSafe(b["stored_month"]), "full_outer")
    different = both.where(~F.col("a").eqNullSafe(F.col("b")))
    return [r[0] for r in different.select(F.when(F.col("a").isNotNull(), F.col("year_month"))
                                           .otherwise(F.col("stored_month"))).collect()]


def refresh_incremental(stories: DataFrame, comments: DataFrame, dictionary, root: str) -> FactStore:
    """Publish a version for the documents as they are now, matching only those
    that are new or whose columns changed.

    Every document's digest is stored by month with the facts.  Months whose digests
    add up to the same are left as they are.  In the others, facts of documents that
    are gone or changed are dropped, those of changed and new ones are matched, and
    the months are written anew.  Where the base tables are partitioned by month, the
    second pass reads these months' folders only.  With another dictionary, or none
    published yet, this is a full refresh; without a change nothing is published.
    """
    store = FactStore(stories.sparkSession, root)
    current = store.manifest()
    if current is None or current["dictionary"] != dictionary.fingerprint():
        return refresh(stories, comments, dictionary, root)
    new, any_change = store.begin(), False
    for docs, (facts, digests, match, columns) in zip((stories, comments), _CORPORA.values()):
        stored = store.read(digests, current["version"])
        months = _changed_months(_digests(docs, columns), stored)
        if not months:
            continue
        any_change = True
        docs = docs.where(in_months(months))
        now, before = _digests(docs, columns), stored.where(in_months(months))
        same = _by_id(now).join(_by_id(before), ["objectid", "n", "sum"], "left_semi").select("objectid")
        old = store.read(facts, current["version"]).where(in_months(months)).join(same, "objectid", "left_semi")
        todo = docs.join(same, "objectid", "left_anti")
        new.write(facts, old.unionByName(match(todo, dictionary).select(*old.columns)), months)
        new.write(digests, now, months)
    if any_change:
        new.commit(dictionary=dictionary.fingerprint())
    return store
