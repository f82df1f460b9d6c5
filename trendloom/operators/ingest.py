"""Incremental ingest (I1-I6) and the hit projections.

The product's loader pages through a search API newest-first and appends
what it has not seen.  Here the same decisions are set-based DataFrame
operations over hit files:

* I1  cursor bounds   — one global aggregate (two numbers reach the driver)
* I2  select_new      — the bounds become literal predicates, which a Parquet
                        scan of the incoming data can use (a JSON one parses
                        every body; ``sources.loaded_files`` skips files)
* I5  newest_batch    — top-k (TakeOrderedAndProject), never a global sort;
                        ``operators.paging`` for cursors that lose no tie
* I6  pending_comments— one semi join replaces the per-thread request loop
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import period
from ..functions.predicates import range_filter, settled
from ..functions.text import unescape_html
from .sample import top_newest

MODES = ("latest", "earliest")


# ---- projections -------------------------------------------------------------

def to_stories(hits: DataFrame) -> DataFrame:
    """objectID, created_at -> submission_date, created_at_i, title, author.

    The title is kept as delivered (not unescaped).  ``year_month`` (P4) is the
    stored derived column.
    """
    return hits.select(
        F.col("objectID").cast("string").alias("objectid"),
        F.col("created_at").alias("submission_date"),
        F.col("created_at_i").cast("long").alias("created_at_i"),
        F.col("title"),
        F.col("author"),
        period("created_at").alias("year_month"),
    )


def to_comments(hits: DataFrame) -> DataFrame:
    """P2 (+P3, P4, P5): comment hits -> hiring_comments rows; ids become text,
    the text is HTML-unescaped (NULL -> '')."""
    return with_comment_columns(hits.select(
        F.col("objectID").cast("string").alias("objectid"),
        unescape_html("comment_text").alias("comment_text"),
        F.col("story_id").cast("string").alias("storyid"),
        F.col("parent_id").cast("string").alias("parentid"),
        F.col("created_at").alias("created_date"),
    ))


def with_comment_columns(comments: DataFrame) -> DataFrame:
    """P4 + P5: stored derived columns of hiring_comments."""
    return comments.select(
        "objectid", "comment_text", "storyid", "parentid", "created_date",
        (F.col("storyid") == F.col("parentid")).alias("is_toplevel_comment"),
        period("created_date").alias("year_month"),
    )


def of_kind(hits: DataFrame, kind: str, story_id: str | None = None) -> DataFrame:
    """I4: hits of one kind (``story`` / ``comment``); comments of one thread."""
    if not kind:
        raise ValueError("kind is required")
    pred = F.array_contains("_tags", kind)
    if story_id is not None:
        pred = pred & (F.col("story_id").cast("string") == F.lit(str(story_id)))
    return hits.where(pred)


# ---- cursor ------------------------------------------------------------------

def bounds(stories: DataFrame, ts_col: str = "created_at_i") -> DataFrame:
    """One row (min_ts, max_ts); both NULL on an empty table."""
    return stories.agg(F.min(ts_col).alias("min_ts"), F.max(ts_col).alias("max_ts"))


def parse_mode(command: str | None) -> str:
    """The loader's command: ``latest`` (default) or ``earliest``; anything else fails."""
    if command is None:
        return "latest"
    if command not in MODES:
        raise ValueError("command must be earliest or latest")
    return command


def search_bounds(mode: str, min_ts, max_ts) -> dict:
    """``latest`` -> lower bound = max; ``earliest`` -> upper bound = min."""
    mode = parse_mode(mode)
    if mode == "earliest":
        return {"gt": None, "lt": min_ts}
    return {"gt": max_ts, "lt": None}


def select_new(incoming: DataFrame, existing: DataFrame, mode: str = "latest",
               ts_col: str = "created_at_i", inclusive: bool = False) -> DataFrame:
    """Incoming rows beyond the existing cursor; everything on the first run.

    The bounds are one aggregate row fetched once and applied as literals, so
    the predicate reaches the scan (PushedFilters).  ``inclusive=True`` also
    keeps rows on the boundary second (the product loses such ties; the
    append operator makes the overlap harmless).
    """
    row = bounds(existing, ts_col).first()
    b = search_bounds(mode, row["min_ts"], row["max_ts"])
    if inclusive:
        c = F.col(ts_col)
        pred = F.lit(True)
        if b["gt"] is not None:
            pred = pred & (c >= F.lit(b["gt"]))
        if b["lt"] is not None:
            pred = pred & (c <= F.lit(b["lt"]))
        return incoming.where(pred)
    return incoming.where(range_filter(ts_col, gt=b["gt"], lt=b["lt"]))


def newest_batch(stories: DataFrame, n: int = 1000, below: int | None = None,
                 ts_col: str = "created_at_i") -> DataFrame:
    """The ``n`` newest rows strictly below the cursor ``below``."""
    src = stories.where(range_filter(ts_col, lt=below))
    return top_newest(src, n, ts_col)


def next_cursor(batch: DataFrame, ts_col: str = "created_at_i") -> DataFrame:
    """The next page starts strictly below the batch's oldest row."""
    return batch.agg(F.min(ts_col).alias("next_below"))


# ---- threads -----------------------------------------------------------------

def unprocessed(threads: DataFrame, log: DataFrame, as_of: str | _dt.date | None = None,
                days: int = 5) -> DataFrame:
    """J1 + F9: settled threads without a log row (NOT EXISTS -> left anti join)."""
    ready = threads.where(settled("submission_date", days, as_of))
    return ready.join(log.select("objectid"), "objectid", "left_anti")


def pending_comments(comments: DataFrame, threads: DataFrame,
                     story_col: str = "storyid") -> DataFrame:
    """Comments of the given threads (one semi join for all threads).

    The thread side is small in practice, but its size is not assumed: the
    planner / AQE broadcasts it only when its measured size allows.
    """
    ids = threads.select(F.col("objectid").alias(story_col))
    return comments.join(ids, story_col, "left_semi")
