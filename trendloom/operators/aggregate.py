"""Aggregations, pivot and audits.

All group-bys aggregate partially before the shuffle (Spark's two-phase
HashAggregate), so a hot word or month is combined map-side and moves as one
row per task.  Results are at most (periods x words) rows.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import current_period


def parse_words(words: str | Iterable[str]) -> list[str]:
    """P10: split the comma-separated argument; keep first occurrences in order.

    ``''`` gives one empty word, which matches nothing.
    """
    items = words.split(",") if isinstance(words, str) else list(words)
    return list(dict.fromkeys(items))


def comment_history(comments: DataFrame, toplevel_only: bool = True) -> DataFrame:
    """A1 / A2 (+F8, O1): comments per month, optionally top-level only."""
    src = comments.where(F.col("is_toplevel_comment")) if toplevel_only else comments
    return (src.groupBy("year_month").agg(F.count(F.lit(1)).alias("num_comments"))
            .orderBy("year_month"))


def hiring_word_counts(hiring_keywords: DataFrame, words: Iterable[str]) -> DataFrame:
    """A3 (+F5, O1): ``count(objectid)`` by (year_month, word)."""
    return (hiring_keywords.where(F.col("word").isin(list(words)))
            .groupBy("year_month", "word")
            .agg(F.count("objectid").alias("num_occurences"))
            .select("word", "year_month", "num_occurences")
            .orderBy("year_month", "word"))


def story_word_counts(keywords: DataFrame, words: Iterable[str],
                      as_of: str | _dt.date | None = None) -> DataFrame:
    """A4 (+F5, F6, O1): ``count(title)`` by (year_month, word), running month excluded."""
    return (keywords.where(F.col("word").isin(list(words))
                           & (F.col("year_month") != current_period(as_of)))
            .groupBy("year_month", "word")
            .agg(F.count("title").alias("num_occurrences"))
            .select("word", "year_month", "num_occurrences")
            .orderBy("year_month", "word"))


def _word_columns(words: Iterable[str]) -> list[str]:
    """The words that become columns: sorted, without the empty one; words that
    differ in case alone are refused, as Spark could not tell their columns apart."""
    values = sorted({w for w in words if w})
    if len({w.lower() for w in values}) < len(values):
        raise ValueError(f"words that differ in case alone cannot be columns of one matrix: {values}")
    return values


def trend_matrix(counts: DataFrame, words: Iterable[str], value_col: str,
                 keep_empty: bool = True) -> DataFrame:
    """A6 (+P11): long (word, year_month, n) -> wide, one bigint column per word.

    Columns are ``year_month`` then the words in alphabetical order; gaps are
    0; a period where no chosen word occurs has no row.  ``keep_empty=False``
    drops the columns of words without any row (the product's behaviour).
    The pivot values are explicit, so the schema is known without a job.
    """
    values = _word_columns(words)
    if not values:
        return counts.select("year_month").distinct().limit(0)
    wide = counts.groupBy("year_month").pivot("word", values).agg(F.sum(value_col))
    if not keep_empty:
        # one computation: the (small) wide result is checkpointed to the
        # shared checkpoint folder, and a word without any row — a column
        # that is NULL everywhere — is dropped by looking at that copy
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(counts.sparkSession)
        wide = wide.checkpoint(eager=True)
        seen = wide.agg(*[F.count(F.col(f"`{w}`")).alias(w) for w in values]).first()
        values = [w for w in values if seen[w] > 0]
    return wide.na.fill(0, subset=values).select(
        "year_month", *[F.col(f"`{w}`").cast("bigint").alias(w) for w in values]
    ).orderBy("year_month")


def wide_counts(facts: DataFrame, words: Iterable[str], count_col: str,
                where=None) -> DataFrame:
    """A3/A4 + A6 fused: the wide matrix straight from the facts.

    One conditional count per word in a single aggregation by period (one
    exchange of at most periods x tasks partial rows), instead of a long
    aggregation followed by a pivot aggregation.  Same rows and values as
    ``trend_matrix(long_counts(...))``: a period appears when a chosen word has
    a fact in it; a word without facts is a 0 column.
    """
    values = _word_columns(words)
    pred = F.col("word").isin(values)
    if where is not None:
        pred = pred & where
    if not values:
        return facts.select("year_month").limit(0)
    return (facts.where(pred).groupBy("year_month")
            .agg(*[F.count(F.when(F.col("word") == w, F.col(count_col))).alias(w) for w in values])
            .orderBy("year_month"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys occurring more than once, with their count."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def audit(df: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """Constraint violations as rows (violation, key, n).

    ``duplicate_key`` rows carry the JSON of the repeated key; ``null:<col>``
    rows the number of NULLs in a required column (only when > 0).
    """
    dups = duplicate_keys(df, keys).select(
        F.lit("duplicate_key").alias("violation"),
        F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key"),
        F.col("n"))
    if not required:
        return dups
    nulls = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in required])
    stacked = nulls.select(F.explode(F.array(*[
        F.struct(F.lit(f"null:{c}").alias("violation"), F.col(c).alias("n")) for c in required
    ])).alias("v")).select(
        "v.violation", F.lit(None).cast("string").alias("key"), "v.n"
    ).where(F.col("n") > 0)
    return dups.unionByName(stacked)
