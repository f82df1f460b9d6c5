"""Registered queries: one per operator of SURVEY §2 that can run on the driver
tables, each ``(spark, sf_dir) -> DataFrame`` over whole tables, with its
DuckDB oracle in :func:`oracle_sql`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as agg
from ..operators import matching
from . import api
from . import fixtures as fx
from . import oracle as osql
from . import registry_load

Query = Callable[[SparkSession, str], DataFrame]

# Word lists of the registered trend queries (a word without rows included).
PART_TREND_WORDS = "ring,bolt,widget,gear,plate,rod,gizmo,anvil,nosuch"
DOC_TREND_WORDS = "the,de,la,ci,nosuch"
STORY_TREND_WORDS = "urgent,low,medium,high,building,furniture"


# ---- shared building blocks ------------------------------------------------------

def part_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, year_month, title) of the large trend input.

    Tokenising runs on the part dimension (one row per part), not on every
    lineitem row; the lineitem side only contributes (partkey, month).  The join's
    strategy is left to the planner and AQE, which know the sides' sizes: a broadcast
    where the postings are small, else a shuffle join with heavy part keys split.
    """
    words = matching.postings(fx.trend_parts(spark, sf_dir), "title", ("p_partkey", "title"), fx.part_dictionary())
    li = fx.trend_periods(spark, sf_dir)
    return (li.join(words, li["l_partkey"] == words["p_partkey"])
            .select("word", "year_month", "title"))


def story_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.story_postings(fx.stories(spark, sf_dir), fx.story_dictionary())


def doc_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.story_postings(fx.doc_stories(spark, sf_dir), fx.doc_dictionary())


def hiring_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.comment_postings(fx.hiring_comments(spark, sf_dir), fx.doc_dictionary())


# ---- queries -------------------------------------------------------------------

def q4_submission_trend(spark, sf_dir):
    return api.submission_trend(part_postings(spark, sf_dir), PART_TREND_WORDS, fx.AS_OF)


def q4_story_submission_trend(spark, sf_dir):
    return api.submission_trend(story_keywords(spark, sf_dir), STORY_TREND_WORDS, fx.AS_OF)


def a4_story_word_counts(spark, sf_dir):
    return agg.story_word_counts(part_postings(spark, sf_dir),
                                 agg.parse_words(PART_TREND_WORDS), fx.AS_OF)


def t7_story_postings(spark, sf_dir):
    return doc_keywords(spark, sf_dir)


def t8_comment_postings(spark, sf_dir):
    return hiring_keywords(spark, sf_dir)


def a3_hiring_word_counts(spark, sf_dir):
    return agg.hiring_word_counts(hiring_keywords(spark, sf_dir),
                                  agg.parse_words(DOC_TREND_WORDS))


def q3_hiring_trend(spark, sf_dir):
    return api.hiring_trend(hiring_keywords(spark, sf_dir), DOC_TREND_WORDS)


def a1_comment_history_all(spark, sf_dir):
    return api.comment_history(fx.hiring_comments(spark, sf_dir), toplevel_only=False)


def q2_comment_history(spark, sf_dir):
    return api.comment_history(fx.hiring_comments(spark, sf_dir), toplevel_only=True)


# ---- sources and sinks ---------------------------------------------------------

def s1_json_hits(spark, sf_dir):
    """S1 + P1: story hits written as paged JSON responses, read back, projected."""
    from ..operators.ingest import to_stories
    from ..session import scratch_path
    from ..sources.hits import read_hits, write_hits
    path = scratch_path(spark, "hits")
    write_hits(fx.story_hits(spark, sf_dir), path)
    return to_stories(read_hits(spark, path))


def s4_table_scan(spark, sf_dir):
    """S4 + S9: stories stored as a partitioned table, scanned with its schema."""
    from ..session import scratch_path
    from ..sources.tables import read_table, write_table
    path = scratch_path(spark, "stories")
    write_table(fx.stories(spark, sf_dir), path, "stories")
    return read_table(spark, path, "stories")


S5_EXISTING_BEFORE = "1998-01-01"
S5_INCOMING_FROM = "1997-01-01"
LINEITEM_KEY = ["l_orderkey", "l_linenumber"]


def s5_append_new(spark, sf_dir):
    """S5 + J5: append lineitem rows (key l_orderkey, l_linenumber) to a stored
    table, doing nothing on conflict; returns the whole table after the append."""
    from ..operators.append import append_new
    from ..session import scratch_path
    li = fx.read(spark, sf_dir, "lineitem")
    path = scratch_path(spark, "lineitem_append")
    li.where(F.col("l_shipdate") < S5_EXISTING_BEFORE).write.parquet(path)
    existing = spark.read.parquet(path)
    incoming = li.where(F.col("l_shipdate") >= S5_INCOMING_FROM)
    new_rows = append_new(existing, incoming, LINEITEM_KEY)
    new_rows.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def s6_refresh(spark, sf_dir):
    """S6 + U3: full refresh of both fact tables; the story facts read back."""
    from ..session import scratch_path
    root = scratch_path(spark, "facts")
    return api.refresh(fx.doc_stories(spark, sf_dir), fx.hiring_comments(spark, sf_dir),
                       fx.doc_dictionary(), root).read("keywords")


INCREMENTAL_FIRST_BEFORE = "2021-01-01"


def u3_refresh_incremental(spark, sf_dir):
    """U3 incremental: a full refresh of the older documents, then an
    incremental one over all of them (only the newer are tokenised)."""
    from ..session import scratch_path
    root = scratch_path(spark, "facts-inc")
    docs, comments, d = fx.doc_stories(spark, sf_dir), fx.hiring_comments(spark, sf_dir), fx.doc_dictionary()
    api.refresh_incremental(docs.where(F.col("submission_date") < INCREMENTAL_FIRST_BEFORE),
                            comments.where(F.col("created_date") < INCREMENTAL_FIRST_BEFORE), d, root)
    return api.refresh_incremental(docs, comments, d, root).read("keywords")


def s6_refresh_hiring(spark, sf_dir):
    """S6 + U3: the comment facts of the same refresh, read back."""
    from ..session import scratch_path
    root = scratch_path(spark, "facts")
    return api.refresh(fx.doc_stories(spark, sf_dir), fx.hiring_comments(spark, sf_dir),
                       fx.doc_dictionary(), root).read("hiring_keywords")


def s7_mark_processed(spark, sf_dir):
    """The unprocessed threads appended to the processed log."""
    from ..operators.ingest import unprocessed
    from ..session import scratch_path
    from ..sources.tables import mark_processed
    path = scratch_path(spark, "hiring_posts_log")
    todo = unprocessed(fx.hiring_threads(spark, sf_dir), fx.thread_log(spark, sf_dir),
                       fx.THREAD_AS_OF)
    mark_processed(todo, path)
    log = spark.read.parquet(path)
    return log.select("objectid", F.col("processed_date").isNotNull().alias("stamped"))


def s8_records(spark, sf_dir):
    """The comment history as JSON records."""
    from ..sources.tables import to_records
    return to_records(api.comment_history(fx.hiring_comments(spark, sf_dir), True))


# ---- ingest ----------------------------------------------------------------------

I1_SPLIT = "1998-01-01"
I3_GT, I3_LT = 820454400, 852076800   # 1996-01-01 .. 1997-01-01, open interval
I5_BELOW = 852076800                  # cursor: below 1997-01-01


def i1_cursor_bounds(spark, sf_dir):
    from ..operators.ingest import bounds
    return bounds(fx.stories(spark, sf_dir))


def i2_select_new_latest(spark, sf_dir):
    from ..operators.ingest import select_new
    s = fx.stories(spark, sf_dir)
    return select_new(s, s.where(F.col("submission_date") < I1_SPLIT), "latest")


def i2_select_new_earliest(spark, sf_dir):
    from ..operators.ingest import select_new
    s = fx.stories(spark, sf_dir)
    return select_new(s, s.where(F.col("submission_date") >= I1_SPLIT), "earliest")


def i3_range_filter(spark, sf_dir):
    from ..functions.predicates import range_filter
    return fx.stories(spark, sf_dir).where(range_filter("created_at_i", gt=I3_GT, lt=I3_LT))


def i4_of_kind(spark, sf_dir):
    from ..operators.ingest import of_kind
    hits = fx.all_hits(spark, sf_dir)
    return of_kind(hits, "comment").select("objectID", "story_id", "parent_id", "created_at")


def i5_newest_batch(spark, sf_dir):
    from ..operators.ingest import newest_batch
    return newest_batch(fx.stories(spark, sf_dir), 1000, I5_BELOW)


def i5_next_cursor(spark, sf_dir):
    from ..operators.ingest import newest_batch, next_cursor
    return next_cursor(newest_batch(fx.stories(spark, sf_dir), 1000, I5_BELOW))


def i6_pending_comments(spark, sf_dir):
    """I6 + J6 + J1: comments of all settled, unprocessed threads."""
    from ..operators.ingest import pending_comments, unprocessed
    todo = unprocessed(fx.hiring_threads(spark, sf_dir), fx.thread_log(spark, sf_dir),
                       fx.THREAD_AS_OF)
    return pending_comments(fx.hiring_comments(spark, sf_dir), todo)


# ---- projections and scalar functions ------------------------------------------------

def p1_story_projection(spark, sf_dir):
    from ..operators.ingest import to_stories
    return to_stories(fx.story_hits(spark, sf_dir))


def p2_comment_projection(spark, sf_dir):
    from ..operators.ingest import to_comments
    return to_comments(fx.comment_hits(spark, sf_dir))


def p3_unescape_html(spark, sf_dir):
    from ..functions.text import unescape_html
    pages = fx.read(spark, sf_dir, "pages")
    return pages.select("page_id", unescape_html("html").alias("text"))


def p6_normalize_terms(spark, sf_dir):
    from ..functions.text import normalize_terms
    docs = fx.read(spark, sf_dir, "documents")
    return docs.select("doc_id", normalize_terms("text").alias("normalized"))


def p7_submission_day(spark, sf_dir):
    from ..functions.dates import to_day
    return fx.stories(spark, sf_dir).select("objectid", to_day("submission_date").alias("submission_day"))


def p12_period_label(spark, sf_dir):
    from ..functions.dates import period_label
    h = api.comment_history(fx.hiring_comments(spark, sf_dir), False)
    return h.select("year_month", period_label("year_month").alias("period_start"), "num_comments")


# ---- filters, joins, views ------------------------------------------------------------

def u4_hiring_stories(spark, sf_dir):
    return api.hiring_stories(fx.stories(spark, sf_dir), fx.HIRING_AUTHORS,
                              fx.HIRING_PREFIX, fx.HIRING_EXCLUDE)


def u2_unprocessed_hiring_stories(spark, sf_dir):
    return api.unprocessed_hiring_stories(fx.stories(spark, sf_dir), fx.story_log(spark, sf_dir),
                                          fx.AS_OF, authors=fx.HIRING_AUTHORS,
                                          prefix=fx.HIRING_PREFIX, exclude=fx.HIRING_EXCLUDE)


def j1_unprocessed_threads(spark, sf_dir):
    from ..operators.ingest import unprocessed
    return unprocessed(fx.hiring_threads(spark, sf_dir), fx.thread_log(spark, sf_dir),
                       fx.THREAD_AS_OF).select("objectid", "submission_date")


F10_WORD = "der"


def f10_contains_word(spark, sf_dir):
    from ..functions.text import contains_word
    d = fx.doc_stories_of(fx.read(spark, sf_dir, "documents"))
    return d.where(contains_word("title", F10_WORD, fx.DOC_SYNONYMS)).select("objectid")


def t5_match_set(spark, sf_dir):
    return matching.match_set(fx.doc_stories(spark, sf_dir), "title", ("objectid",),
                              fx.DOC_SYNONYMS)


def u1_sql_function(spark, sf_dir):
    api.register_sql_functions(spark)
    fx.read(spark, sf_dir, "documents").createOrReplaceTempView("trendloom_documents")
    return spark.sql("SELECT doc_id, normalize_terms(text) AS normalized FROM trendloom_documents")


# ---- aggregates, pivot, audits, samples --------------------------------------------------

def a6_trend_matrix_exact(spark, sf_dir):
    """A6 with keep_empty=False: a word without rows gets no column."""
    counts = agg.story_word_counts(part_postings(spark, sf_dir),
                                   agg.parse_words(PART_TREND_WORDS), fx.AS_OF)
    return agg.trend_matrix(counts, agg.parse_words(PART_TREND_WORDS), "num_occurrences",
                            keep_empty=False)


def a7_key_uniqueness(spark, sf_dir):
    return agg.duplicate_keys(doc_keywords(spark, sf_dir), ["word", "objectid"])


A8_REQUIRED = ["l_orderkey", "l_linenumber", "l_shipdate"]


def a8_constraint_audit(spark, sf_dir):
    return agg.audit(fx.read(spark, sf_dir, "lineitem"), LINEITEM_KEY, A8_REQUIRED)


Q5_WORD, Q5_PERIOD = "the", "2019-03"


def q5_submission_samples(spark, sf_dir):
    return api.submission_samples(doc_keywords(spark, sf_dir), Q5_WORD, Q5_PERIOD,
                                  order=F.md5("objectid"), url_prefix=fx.ITEM_URL_PREFIX)


def j4_canonicalize_join(spark, sf_dir):
    """J4/J2 for dictionaries too large for a map literal: chunks joined to the
    synonym table, compound parts to the canonical words (same result as T7)."""
    kw = spark.createDataFrame(sorted(fx.DOC_KEYWORDS.items()), "keyword string, include_hiring boolean")
    syn = spark.createDataFrame(sorted(fx.DOC_SYNONYMS.items()), "token string, canonical string")
    return matching.postings_by_join(fx.doc_stories(spark, sf_dir), "title",
                                     matching.STORY_POSTING_COLUMNS, kw, syn)


def t7_stories_postings(spark, sf_dir):
    """T7 over the stories (titles such as ``building 1-URGENT``: compounds)."""
    return story_keywords(spark, sf_dir)


def p3_unescape_html_full(spark, sf_dir):
    """P3, every named and numeric reference, over the whole pages."""
    from ..functions.text import unescape_html
    return fx.read(spark, sf_dir, "pages").select("page_id", unescape_html("html").alias("text"))


# ---- vocabulary files (S2, S3, Q1, T6) -------------------------------------------

def _written_part_vocabulary(spark, sf_dir):
    """The part-name vocabulary written as a CSV keyword list and a
    whitespace-separated synonym file, read back with the S2 / S3 readers."""
    from ..session import scratch_path
    from ..sources.dictionary import read_keyword_list, read_synonyms
    root = scratch_path(spark, "vocab")
    keywords, synonyms = fx.part_vocabulary(spark, sf_dir)
    keywords.write.option("header", True).csv(f"{root}/words")
    synonyms.select(F.concat_ws("          ", "token", "canonical")).write.text(f"{root}/synonyms")
    return read_keyword_list(spark, f"{root}/words"), read_synonyms(spark, f"{root}/synonyms")


def q1_keyword_listing(spark, sf_dir):
    """Q1 (S2 + F4 + P9): the hiring keyword listing of a CSV keyword file."""
    keywords, _ = _written_part_vocabulary(spark, sf_dir)
    return api.keyword_listing(keywords, hiring=True)


def t6_effective_vocabulary(spark, sf_dir):
    """T6 (S2 + S3 + J4): keywords through the synonym file; unknown ones drop out."""
    from ..sources.dictionary import effective_vocabulary
    keywords, synonyms = _written_part_vocabulary(spark, sf_dir)
    return effective_vocabulary(keywords, synonyms)


# ---- the recurring load -----------------------------------------------------------

LOAD_EXISTING_BEFORE = "1998-01-01"


def load_stories_run(spark, sf_dir):
    """I1-I4 + S1 + P1 + S5 + S4: a stored table of the older stories, then one
    ``latest`` load of all story and comment hits (JSON pages)."""
    from ..plans.loader import load_stories
    from ..session import scratch_path
    from ..sources.hits import write_hits
    from ..sources.tables import write_table
    root = scratch_path(spark, "load")
    s = fx.stories(spark, sf_dir)
    write_table(s.where(F.col("submission_date") < LOAD_EXISTING_BEFORE), f"{root}/stories", "stories")
    write_hits(fx.all_hits(spark, sf_dir), f"{root}/hits")
    return load_stories(spark, f"{root}/hits", f"{root}/stories", "latest")


def process_comments_run(spark, sf_dir):
    """U2 + I6 + P2 + S5 + S7: comments of every settled, unprocessed thread
    loaded from the hit files; threads created before 2021 are already logged."""
    from ..plans.loader import process_all_comments
    from ..session import scratch_path
    from ..sources.hits import write_hits
    from ..sources.tables import mark_processed
    root = scratch_path(spark, "comments")
    write_hits(fx.all_hits(spark, sf_dir), f"{root}/hits")
    mark_processed(fx.thread_log(spark, sf_dir), f"{root}/log")
    threads = fx.hiring_threads(spark, sf_dir)
    return process_all_comments(spark, f"{root}/hits", threads, f"{root}/comments", f"{root}/log",
                                fx.THREAD_AS_OF, authors=["user"], prefix="", exclude=[])


# ---- streaming -------------------------------------------------------------------

def _run(query) -> None:
    query.awaitTermination()      # to the end of the available input; raises if the query failed


def r1_stream_ingest(spark, sf_dir):
    """The events stream ingested once per event_id into an append-only sink."""
    from ..session import scratch_path
    from ..streaming.streams import ingest_stream, stream_table
    root = scratch_path(spark, "r1")
    ev = stream_table(spark, sf_dir, "events").withColumn("event_time", F.col("ts").cast("timestamp"))
    _run(ingest_stream(ev, f"{root}/sink", f"{root}/checkpoint", ["event_id"], "event_time"))
    return spark.read.parquet(f"{root}/sink").select(
        "event_id", "ts", "user_id", "event_type", "value", "props")


def r2_stream_postings(spark, sf_dir):
    """R2: comment postings computed on the conversations stream."""
    from ..session import scratch_path
    from ..streaming.streams import postings_stream, stream_table
    root = scratch_path(spark, "r2")
    comments = fx.hiring_comments_of(stream_table(spark, sf_dir, "conversations"))
    _run(postings_stream(comments, fx.doc_dictionary(), f"{root}/sink", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/sink").select("word", "objectid", "year_month")


def r3_stream_window_counts(spark, sf_dir):
    """Daily (window, word) counts of the comment postings stream."""
    from ..session import scratch_path
    from ..streaming.streams import latest_counts, stream_table, windowed_counts_stream
    root = scratch_path(spark, "r3")
    comments = fx.hiring_comments_of(stream_table(spark, sf_dir, "conversations"))
    facts = matching.postings(comments, "comment_text", ("objectid", "created_date"),
                              fx.doc_dictionary(), hiring_only=True)
    facts = facts.withColumn("event_time", F.to_timestamp("created_date"))
    _run(windowed_counts_stream(facts, "event_time", f"{root}/sink", f"{root}/checkpoint"))
    out = latest_counts(spark, f"{root}/sink")
    return out.select(F.date_from_unix_date((F.col("window_start_s") / 86400).cast("int")).alias("day"),
                      "word", "n")


def r3_monthly_rollup(spark, sf_dir):
    """R3 + batch roll-up: the streamed daily counts summed per calendar month
    (equals A3's monthly counts of the comment postings)."""
    from ..session import scratch_path
    from ..streaming.streams import latest_counts, monthly_rollup, stream_table, windowed_counts_stream
    root = scratch_path(spark, "r3m")
    comments = fx.hiring_comments_of(stream_table(spark, sf_dir, "conversations"))
    facts = matching.postings(comments, "comment_text", ("objectid", "created_date"),
                              fx.doc_dictionary(), hiring_only=True)
    facts = facts.withColumn("event_time", F.to_timestamp("created_date"))
    _run(windowed_counts_stream(facts, "event_time", f"{root}/sink", f"{root}/checkpoint"))
    return monthly_rollup(latest_counts(spark, f"{root}/sink"))


def queries() -> dict[str, Query]:
    return {
        "q4_submission_trend": q4_submission_trend,
        "q4_story_submission_trend": q4_story_submission_trend,
        "a4_story_word_counts": a4_story_word_counts,
        "t7_story_postings": t7_story_postings,
        "t8_comment_postings": t8_comment_postings,
        "a3_hiring_word_counts": a3_hiring_word_counts,
        "q3_hiring_trend": q3_hiring_trend,
        "a1_comment_history_all": a1_comment_history_all,
        "q2_comment_history": q2_comment_history,
        "s1_json_hits": s1_json_hits,
        "s4_table_scan": s4_table_scan,
        "s5_append_new": s5_append_new,
        "s6_refresh": s6_refresh,
        "s6_refresh_hiring": s6_refresh_hiring,
        "u3_refresh_incremental": u3_refresh_incremental,
        "s7_mark_processed": s7_mark_processed,
        "s8_records": s8_records,
        "i1_cursor_bounds": i1_cursor_bounds,
        "i2_select_new_latest": i2_select_new_latest,
        "i2_select_new_earliest": i2_select_new_earliest,
        "i3_range_filter": i3_range_filter,
        "i4_of_kind": i4_of_kind,
        "i5_newest_batch": i5_newest_batch,
        "i5_next_cursor": i5_next_cursor,
        "i6_pending_comments": i6_pending_comments,
        "p1_story_projection": p1_story_projection,
        "p2_comment_projection": p2_comment_projection,
        "p3_unescape_html": p3_unescape_html,
        "p6_normalize_terms": p6_normalize_terms,
        "p7_submission_day": p7_submission_day,
        "p12_period_label": p12_period_label,
        "u4_hiring_stories": u4_hiring_stories,
        "u2_unprocessed_hiring_stories": u2_unprocessed_hiring_stories,
        "j1_unprocessed_threads": j1_unprocessed_threads,
        "f10_contains_word": f10_contains_word,
        "t5_match_set": t5_match_set,
        "u1_sql_function": u1_sql_function,
        "a6_trend_matrix_exact": a6_trend_matrix_exact,
        "a7_key_uniqueness": a7_key_uniqueness,
        "a8_constraint_audit": a8_constraint_audit,
        "q5_submission_samples": q5_submission_samples,
        "q1_keyword_listing": q1_keyword_listing,
        "t6_effective_vocabulary": t6_effective_vocabulary,
        "i2_load_stories": load_stories_run,
        "i6_process_all_comments": process_comments_run,
        "j4_canonicalize_join": j4_canonicalize_join,
        "t7_stories_postings": t7_stories_postings,
        "p3_unescape_html_full": p3_unescape_html_full,
        "r1_stream_ingest": r1_stream_ingest,
        "r2_stream_postings": r2_stream_postings,
        "r3_stream_window_counts": r3_stream_window_counts,
        "r3_monthly_rollup": r3_monthly_rollup,
    } | registry_load.queries()


# ---- oracle ------------------------------------------------------------------------

def _part_postings_sql() -> str:
    m = osql.postings_sql(osql.TREND_PARTS, ["p_partkey"], "title", fx.part_dictionary(),
                          extra=["title"])
    return (f"SELECT pp.word, li.year_month, pp.title FROM ({osql.TREND_PERIODS}) li "
            f"JOIN ({m}) pp ON li.l_partkey = pp.p_partkey")


def _story_word_counts_sql(postings: str, words: str, as_of: str) -> str:
    ws = ", ".join(osql.q(w) for w in agg.parse_words(words))
    return (f"SELECT word, year_month, count(title) AS num_occurrences FROM ({postings}) k "
            f"WHERE word IN ({ws}) AND year_month <> {osql.q(osql.current_period(as_of))} "
            f"GROUP BY year_month, word")


def _doc_postings_sql() -> str:
    return osql.postings_sql(osql.DOC_STORIES, ["objectid"], "title", fx.doc_dictionary(),
                             extra=["submission_date", "title", "year_month"])


def _story_postings_sql() -> str:
    return osql.postings_sql(osql.STORIES, ["objectid"], "title", fx.story_dictionary(),
                             extra=["submission_date", "title", "year_month"])


def _comment_postings_sql() -> str:
    return osql.postings_sql(osql.HIRING_COMMENTS, ["objectid"], "comment_text",
                             fx.doc_dictionary(), hiring_only=True, extra=["year_month"])


def _hiring_word_counts_sql(words: str) -> str:
    ws = ", ".join(osql.q(w) for w in agg.parse_words(words))
    return (f"SELECT word, year_month, count(objectid) AS num_occurences "
            f"FROM ({_comment_postings_sql()}) k WHERE word IN ({ws}) GROUP BY year_month, word")


def _stories_where(pred: str) -> str:
    return f"SELECT * FROM ({osql.STORIES}) s WHERE {pred}"


def _hiring_stories_sql() -> str:
    authors = ", ".join(osql.q(a) for a in fx.HIRING_AUTHORS)
    excl = ", ".join(osql.q(a) for a in fx.HIRING_EXCLUDE)
    return _stories_where(f"author IN ({authors}) AND starts_with(lower(title), {osql.q(fx.HIRING_PREFIX)}) "
                          f"AND objectid NOT IN ({excl})")


def _settled(col: str, as_of: str, days: int = 5) -> str:
    return f"CAST(substr({col}, 1, 10) AS DATE) < DATE {osql.q(as_of)} - INTERVAL {days} DAY"


def _unprocessed_threads_sql() -> str:
    return (f"SELECT * FROM ({osql.HIRING_THREADS}) t WHERE {_settled('submission_date', fx.THREAD_AS_OF)} "
            f"AND NOT EXISTS (SELECT 1 FROM ({osql.THREAD_LOG}) l WHERE l.objectid = t.objectid)")


def _lineitem_append_sql() -> str:
    cols = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
    existing = f"SELECT {cols} FROM lineitem WHERE l_shipdate < TIMESTAMP {osql.q(S5_EXISTING_BEFORE)}"
    incoming = (f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber "
                f"ORDER BY {cols}) AS rn FROM lineitem WHERE l_shipdate >= TIMESTAMP {osql.q(S5_INCOMING_FROM)}) x WHERE rn = 1")
    fresh = (f"SELECT * FROM ({incoming}) i WHERE NOT EXISTS (SELECT 1 FROM ({existing}) e "
             f"WHERE e.l_orderkey = i.l_orderkey AND e.l_linenumber = i.l_linenumber)")
    return f"{existing} UNION ALL {fresh}"


def _comment_history_sql(toplevel_only: bool) -> str:
    where = " WHERE is_toplevel_comment" if toplevel_only else ""
    return (f"SELECT year_month, count(*) AS num_comments FROM ({osql.HIRING_COMMENTS}) c{where} "
            f"GROUP BY year_month")


# Fixed values of the P3 oracle: the references that the pages hold, and their like;
# ``&amp;`` comes last, so that a chain of replacements makes one pass.
ORACLE_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
    ("&#39;", "'"), ("&#x27;", "'"), ("&#34;", '"'), ("&#x2F;", "/"), ("&#47;", "/"),
    ("&#60;", "<"), ("&#62;", ">"), ("&nbsp;", " "), ("&copy;", "©"),
    ("&reg;", "®"), ("&middot;", "·"), ("&hellip;", "…"),
    ("&mdash;", "—"), ("&ndash;", "–"),
    ("&#38;", "&"), ("&amp;", "&"),
)


def _unescape_sql(expr: str) -> str:
    out = expr
    for search, repl in ORACLE_ENTITIES:
        out = f"replace({out}, {osql.q(search)}, {osql.q(repl)})"
    return f"coalesce({out}, '')"


def _all_hits_comments_sql() -> str:
    conv = "CAST(conv_id AS VARCHAR)"
    day = osql._day(fx.THREAD_EPOCH, "conv_id * 11 % 1800 + turn")
    return (f"SELECT {conv} || '-' || CAST(turn AS VARCHAR) AS objectID, {conv} || '-0' AS story_id, "
            f"{conv} || '-' || CAST(turn - 1 AS VARCHAR) AS parent_id, {osql.iso(day)} AS created_at "
            f"FROM conversations WHERE turn > 0")


def _doc_match_set_sql() -> str:
    m = osql.match_sql(osql.DOC_STORIES, ["objectid"], "title", fx.DOC_SYNONYMS)
    return f"SELECT objectid, canonical AS word FROM ({m}) m"


def _normalize_docs_sql() -> str:
    return f"SELECT doc_id, {osql.normalize_sql('text')} AS normalized FROM documents"


_PART_WORDS_SQL = ("SELECT DISTINCT w FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) x "
                   "WHERE w <> ''")


def oracle_sql() -> dict[str, str]:
    ws = agg.parse_words
    return {
        "q4_submission_trend": osql.pivot_sql(
            _story_word_counts_sql(_part_postings_sql(), PART_TREND_WORDS, fx.AS_OF),
            ws(PART_TREND_WORDS), "num_occurrences"),
        "q4_story_submission_trend": osql.pivot_sql(
            _story_word_counts_sql(_story_postings_sql(), STORY_TREND_WORDS, fx.AS_OF),
            ws(STORY_TREND_WORDS), "num_occurrences"),
        "a4_story_word_counts": _story_word_counts_sql(_part_postings_sql(), PART_TREND_WORDS, fx.AS_OF),
        "t7_story_postings": _doc_postings_sql(),
        "t8_comment_postings": _comment_postings_sql(),
        "a3_hiring_word_counts": _hiring_word_counts_sql(DOC_TREND_WORDS),
        "q3_hiring_trend": osql.pivot_sql(_hiring_word_counts_sql(DOC_TREND_WORDS),
                                          ws(DOC_TREND_WORDS), "num_occurences"),
        "a1_comment_history_all": f"SELECT year_month, count(*) AS num_comments FROM ({osql.HIRING_COMMENTS}) c GROUP BY year_month",
        "q2_comment_history": f"SELECT year_month, count(*) AS num_comments FROM ({osql.HIRING_COMMENTS}) c WHERE is_toplevel_comment GROUP BY year_month",
        "s1_json_hits": osql.STORIES,
        "s4_table_scan": osql.STORIES,
        "s5_append_new": _lineitem_append_sql(),
        "s6_refresh": _doc_postings_sql(),
        "s6_refresh_hiring": _comment_postings_sql(),
        "u3_refresh_incremental": _doc_postings_sql(),
        "s7_mark_processed": f"SELECT objectid, TRUE AS stamped FROM ({_unprocessed_threads_sql()}) u",
        "s8_records": f"SELECT to_json(struct_pack(year_month := year_month, num_comments := num_comments)) AS record FROM ({_comment_history_sql(True)}) h",
        "i1_cursor_bounds": f"SELECT min(created_at_i) AS min_ts, max(created_at_i) AS max_ts FROM ({osql.STORIES}) s",
        "i2_select_new_latest": _stories_where(f"created_at_i > (SELECT max(created_at_i) FROM ({osql.STORIES}) e WHERE submission_date < {osql.q(I1_SPLIT)})"),
        "i2_select_new_earliest": _stories_where(f"created_at_i < (SELECT min(created_at_i) FROM ({osql.STORIES}) e WHERE submission_date >= {osql.q(I1_SPLIT)})"),
        "i3_range_filter": _stories_where(f"created_at_i > {I3_GT} AND created_at_i < {I3_LT}"),
        "i4_of_kind": _all_hits_comments_sql(),
        "i5_newest_batch": _stories_where(f"created_at_i < {I5_BELOW}") + " ORDER BY created_at_i DESC, objectid DESC LIMIT 1000",
        "i5_next_cursor": f"SELECT min(created_at_i) AS next_below FROM ({_stories_where(f'created_at_i < {I5_BELOW}')} ORDER BY created_at_i DESC, objectid DESC LIMIT 1000) b",
        "i6_pending_comments": f"SELECT * FROM ({osql.HIRING_COMMENTS}) c WHERE storyid IN (SELECT objectid FROM ({_unprocessed_threads_sql()}) u)",
        "p1_story_projection": osql.STORIES,
        "p2_comment_projection": osql.HIRING_COMMENTS,
        "p3_unescape_html": f"SELECT page_id, {_unescape_sql('html')} AS text FROM pages",
        "p6_normalize_terms": _normalize_docs_sql(),
        "p7_submission_day": f"SELECT objectid, CAST(substr(submission_date, 1, 10) AS DATE) AS submission_day FROM ({osql.STORIES}) s",
        "p12_period_label": f"SELECT year_month, year_month || '-01' AS period_start, num_comments FROM ({_comment_history_sql(False)}) h",
        "u4_hiring_stories": _hiring_stories_sql(),
        "u2_unprocessed_hiring_stories": (f"SELECT objectid FROM ({_hiring_stories_sql()}) h WHERE {_settled('submission_date', fx.AS_OF)} "
                                          f"AND NOT EXISTS (SELECT 1 FROM ({osql.STORY_LOG}) l WHERE l.objectid = h.objectid)"),
        "j1_unprocessed_threads": f"SELECT objectid, submission_date FROM ({_unprocessed_threads_sql()}) u",
        "f10_contains_word": f"SELECT DISTINCT objectid FROM ({_doc_match_set_sql()}) m WHERE word = {osql.q(fx.DOC_SYNONYMS[F10_WORD])}",
        "t5_match_set": _doc_match_set_sql(),
        "u1_sql_function": _normalize_docs_sql(),
        "a6_trend_matrix_exact": osql.pivot_sql(
            _story_word_counts_sql(_part_postings_sql(), PART_TREND_WORDS, fx.AS_OF),
            [w for w in ws(PART_TREND_WORDS) if w != "nosuch"], "num_occurrences"),
        "a7_key_uniqueness": f"SELECT word, objectid, count(*) AS n FROM ({_doc_postings_sql()}) k GROUP BY word, objectid HAVING count(*) > 1",
        "a8_constraint_audit": (
            "SELECT 'duplicate_key' AS violation, to_json(struct_pack(l_orderkey := l_orderkey, l_linenumber := l_linenumber)) AS key, count(*) AS n "
            "FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL "
            "SELECT violation, CAST(NULL AS VARCHAR) AS key, n FROM ("
            + " UNION ALL ".join(f"SELECT 'null:{c}' AS violation, count(*) FILTER (WHERE {c} IS NULL) AS n FROM lineitem" for c in A8_REQUIRED)
            + ") z WHERE n > 0"),
        "q5_submission_samples": (f"SELECT title, objectid, CAST(substr(submission_date, 1, 10) AS DATE) AS submission_date, "
                                  f"{osql.q(fx.ITEM_URL_PREFIX)} || objectid AS url FROM ({_doc_postings_sql()}) k "
                                  f"WHERE word = {osql.q(Q5_WORD)} AND year_month = {osql.q(Q5_PERIOD)} ORDER BY md5(objectid) LIMIT 5"),
        "q1_keyword_listing": (f"SELECT w AS value, upper(w) AS display_name, length(w) > 3 AS include_hiring, "
                               f"w || '.svg' AS image_path FROM ({_PART_WORDS_SQL}) pw WHERE length(w) > 3"),
        "t6_effective_vocabulary": (f"SELECT w AS keyword, w AS canonical, length(w) > 3 AS include_hiring "
                                    f"FROM ({_PART_WORDS_SQL}) pw WHERE length(w) > 3"),
        "i2_load_stories": (_stories_where(f"submission_date < {osql.q(LOAD_EXISTING_BEFORE)}") + " UNION ALL "
                            + _stories_where(f"created_at_i > (SELECT max(created_at_i) FROM ({osql.STORIES}) e "
                                             f"WHERE submission_date < {osql.q(LOAD_EXISTING_BEFORE)})")),
        "i6_process_all_comments": (f"SELECT * FROM ({osql.HIRING_COMMENTS}) c WHERE storyid IN (SELECT objectid FROM "
                                    f"({osql.HIRING_THREADS}) t WHERE author = 'user' AND {_settled('submission_date', fx.THREAD_AS_OF)} "
                                    f"AND submission_date >= {osql.q(fx.THREAD_LOG_BEFORE)})"),
        "j4_canonicalize_join": _doc_postings_sql(),
        "t7_stories_postings": _story_postings_sql(),
        "p3_unescape_html_full": f"SELECT page_id, {_unescape_sql('html')} AS text FROM pages",
        "r1_stream_ingest": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
        "r2_stream_postings": _comment_postings_sql(),
        "r3_stream_window_counts": (
            "SELECT CAST(substr(created_date, 1, 10) AS DATE) AS day, word, count(*) AS n FROM ("
            + osql.postings_sql(osql.HIRING_COMMENTS, ["objectid"], "comment_text", fx.doc_dictionary(),
                                hiring_only=True, extra=["created_date"])
            + ") k GROUP BY 1, 2"),
        "r3_monthly_rollup": (f"SELECT year_month, word, count(*) AS num_occurences FROM ({_comment_postings_sql()}) k "
                              f"GROUP BY year_month, word"),
    } | registry_load.oracle_sql()
