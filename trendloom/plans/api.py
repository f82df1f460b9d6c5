"""The product's query surface, composed from the operators.

Each function takes DataFrames (tables) and plain parameters and returns a
DataFrame; nothing is collected except the bounded argument lists.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import current_period, item_url, to_day
from ..functions.predicates import author_in, not_excluded, title_prefix
from ..functions.text import TERM_REPLACEMENTS
from ..operators import aggregate as agg
from ..operators.ingest import unprocessed
from ..operators.sample import sample_rows
from .facts import refresh, refresh_incremental  # noqa: F401  (U3)

# FIXED VALUES of the hiring-thread view: posting accounts, title prefix and
# the one excluded thread id.
HIRING_AUTHORS = ("whoishiring", "_whoishiring", "lpolovets", "Aloisius")
HIRING_TITLE_PREFIX = "ask hn: who is hiring?"
HIRING_EXCLUDED_IDS = ("3300371",)
SETTLE_DAYS = 5
SAMPLE_SIZE = 5


def keyword_listing(keyword_list: DataFrame, hiring: bool = False) -> DataFrame:
    """Q1 (S2 + F4 + P9): the vocabulary, optionally only hiring keywords."""
    src = keyword_list.where(F.col("include_hiring")) if hiring else keyword_list
    return src.select(F.col("keyword").alias("value"), "display_name",
                      "include_hiring", "image_path")


def hiring_stories(stories: DataFrame, authors: Iterable[str] = HIRING_AUTHORS,
                   prefix: str = HIRING_TITLE_PREFIX,
                   exclude: Iterable[str] = HIRING_EXCLUDED_IDS) -> DataFrame:
    """U4 (F1-F3): the monthly hiring threads among the stories."""
    return stories.where(author_in(authors) & title_prefix(prefix) & not_excluded(exclude))


def register_hiring_stories_view(stories: DataFrame, name: str = "hiring_stories",
                                 **params) -> DataFrame:
    """U4 as a temporary view."""
    view = hiring_stories(stories, **params)
    view.createOrReplaceTempView(name)
    return view


def unprocessed_hiring_stories(stories: DataFrame, log: DataFrame,
                               as_of: str | _dt.date | None = None,
                               days: int = SETTLE_DAYS, **params) -> DataFrame:
    """U2 (F1-F3 + F9 + J1): settled hiring threads not yet in the log."""
    return unprocessed(hiring_stories(stories, **params), log, as_of, days).select("objectid")


def comment_history(comments: DataFrame, toplevel_only: bool = True) -> DataFrame:
    """Q2 (A1/A2 + O1)."""
    return agg.comment_history(comments, toplevel_only)


def hiring_trend(hiring_keywords: DataFrame, keywords: str | Iterable[str],
                 keep_empty: bool = True) -> DataFrame:
    """Q3 (P10 + F5 + A3 + A6): words -> wide monthly matrix of comment matches."""
    words = agg.parse_words(keywords)
    if keep_empty:
        return agg.wide_counts(hiring_keywords, words, "objectid")
    counts = agg.hiring_word_counts(hiring_keywords, words)
    return agg.trend_matrix(counts, words, "num_occurences", keep_empty)


def submission_trend(keywords: DataFrame, words: str | Iterable[str],
                     as_of: str | _dt.date | None = None,
                     keep_empty: bool = True) -> DataFrame:
    """Q4 (P10 + F5 + F6 + A4 + A6): words -> wide monthly matrix of story matches."""
    ws = agg.parse_words(words)
    if keep_empty:
        return agg.wide_counts(keywords, ws, "title",
                               where=F.col("year_month") != current_period(as_of))
    counts = agg.story_word_counts(keywords, ws, as_of)
    return agg.trend_matrix(counts, ws, "num_occurrences", keep_empty)


def submission_samples(keywords: DataFrame, keyword: str, year_month: str,
                       n: int = SAMPLE_SIZE, seed: int | None = None,
                       order: Column | None = None,
                       url_prefix: str | None = None) -> DataFrame:
    """Q5 (F7 + P7 + O2 [+ P13]): up to ``n`` matching stories of one point."""
    hits = keywords.where((F.col("word") == keyword) & (F.col("year_month") == year_month))
    cols = [F.col("title"), F.col("objectid"), to_day("submission_date").alias("submission_date")]
    if url_prefix is not None:
        cols.append(item_url("objectid", url_prefix).alias("url"))
    return sample_rows(hits, n, seed, order).select(*cols)


def register_sql_functions(spark: SparkSession) -> None:
    """``normalize_terms(text)`` as a SQL function (a Spark SQL UDF body,
    so it stays a native expression inside whole-stage codegen)."""
    body = "lower(text)"
    for search, repl in TERM_REPLACEMENTS:
        body = f"replace({body}, '{search}', '{repl}')"
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION normalize_terms(text STRING) "
              f"RETURNS STRING RETURN {body}")
