"""Stand-in views of the product's tables, derived by Spark from the driver's
TPC-H-like tables (see FIXTURES.md).  All are plain DataFrame expressions over
whole tables; their size grows with the input.

``stories``          orders x customer (15,000 rows at sf0.01), titles such as
                     ``building 1-URGENT`` exercise compounds
``doc_stories``      documents: long multilingual text
``hiring_comments``  conversations, turn > 0 (turn 0 is the thread)
``hiring_threads``   conversations, turn = 0
``trend_titles``     lineitem x part: the large trend input (no unique id)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import epoch_seconds, iso_utc, period
from ..operators.partitioning import spread
from ..session import table_path
from ..sources.dictionary import Dictionary

# ---- fixture parameters -------------------------------------------------------

AS_OF = "1998-06-15"              # fixed "today" for F6 / F9 on the TPC-H dates
THREAD_AS_OF = "2023-06-01"       # fixed "today" for the conversation threads
THREAD_EPOCH = "2019-01-01"       # first synthetic thread day
HIRING_AUTHORS = ("Customer#000000001", "Customer#000000002",
                  "Customer#000000003", "Customer#000000004")
HIRING_PREFIX = "machinery"
HIRING_EXCLUDE = ("2762",)
THREAD_LOG_BEFORE = "2021-01-01"  # threads of earlier runs are in the log
ITEM_URL_PREFIX = "https://forum.example.org/item?id="

# Test vocabularies: words that occur in the driver's text (FIXTURES.md §4).
DOC_SYNONYMS = {"the": "the", "de": "de", "der": "de", "la": "la", "el": "la",
                "and": "and", "ci": "ci", "nosuch": "nosuch"}
DOC_KEYWORDS = {"the": True, "de": True, "la": True, "and": False, "ci": True,
                "nosuch": True, "orphan": True}
PART_WORDS = ("ring", "bolt", "widget", "gear", "plate", "rod", "gizmo", "anvil")
STORY_WORDS = ("urgent", "low", "medium", "high", "building", "furniture")


def doc_dictionary() -> Dictionary:
    return Dictionary.of(DOC_SYNONYMS, DOC_KEYWORDS)


def part_dictionary() -> Dictionary:
    return Dictionary.of({w: w for w in PART_WORDS}, {w: True for w in PART_WORDS})


def story_dictionary() -> Dictionary:
    return Dictionary.of({w: w for w in STORY_WORDS}, {w: True for w in STORY_WORDS})


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


# ---- views -------------------------------------------------------------------

def _day(base: str, offset) -> F.Column:
    return F.date_add(F.lit(base).cast("date"), offset.cast("int"))


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    c = read(spark, sf_dir, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    sub = iso_utc("o_orderdate")
    return j.select(
        F.col("o_orderkey").cast("string").alias("objectid"),
        sub.alias("submission_date"),
        epoch_seconds("o_orderdate").alias("created_at_i"),
        F.concat(F.lower("c_mktsegment"), F.lit(" "), F.col("o_orderpriority")).alias("title"),
        F.col("c_name").alias("author"),
        period(sub).alias("year_month"),
    )


def doc_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the text corpus is spread at the scan when it has fewer splits than cores
    return doc_stories_of(spread(read(spark, sf_dir, "documents"), "doc_id"))


def doc_stories_of(d: DataFrame) -> DataFrame:
    """The story view over a documents DataFrame."""
    day = _day(THREAD_EPOCH, F.col("doc_id") * 7 % 1800)
    sub = iso_utc(day.cast("timestamp_ntz"))
    return d.select(
        F.col("doc_id").cast("string").alias("objectid"),
        sub.alias("submission_date"),
        epoch_seconds(day.cast("timestamp_ntz")).alias("created_at_i"),
        F.col("text").alias("title"),
        F.col("source").alias("author"),
        period(sub).alias("year_month"),
    )


def _thread_day(turn_offset=None) -> F.Column:
    off = F.col("conv_id") * 11 % 1800
    if turn_offset is not None:
        off = off + turn_offset
    return _day(THREAD_EPOCH, off)


def hiring_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments: the comment's own day is the thread's day + its turn."""
    return hiring_comments_of(spread(read(spark, sf_dir, "conversations")))


def hiring_comments_of(conversations: DataFrame) -> DataFrame:
    """The comment view over a conversations DataFrame (batch or streaming)."""
    cv = conversations.where(F.col("turn") > 0)
    conv = F.col("conv_id").cast("string")
    created = iso_utc(_thread_day(F.col("turn")).cast("timestamp_ntz"))
    storyid = F.concat(conv, F.lit("-0"))
    parentid = F.concat(conv, F.lit("-"), (F.col("turn") - 1).cast("string"))
    return cv.select(
        F.concat(conv, F.lit("-"), F.col("turn").cast("string")).alias("objectid"),
        F.col("text").alias("comment_text"),
        storyid.alias("storyid"),
        parentid.alias("parentid"),
        created.alias("created_date"),
        (storyid == parentid).alias("is_toplevel_comment"),
        period(created).alias("year_month"),
    )


def hiring_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = read(spark, sf_dir, "conversations").where(F.col("turn") == 0)
    day = _thread_day().cast("timestamp_ntz")
    sub = iso_utc(day)
    return cv.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-0")).alias("objectid"),
        sub.alias("submission_date"),
        epoch_seconds(day).alias("created_at_i"),
        F.col("text").alias("title"),
        F.col("role").alias("author"),
        period(sub).alias("year_month"),
    )


def thread_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hiring_posts_log stand-in for threads: those an earlier run processed."""
    t = hiring_threads(spark, sf_dir)
    return t.where(F.col("submission_date") < THREAD_LOG_BEFORE).select("objectid")


def story_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hiring_posts_log stand-in for stories: fulfilled orders count as processed."""
    o = read(spark, sf_dir, "orders")
    return o.where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").cast("string").alias("objectid"))


def comment_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw comment hits as the search API returns them (numeric-looking ids as
    text, entity-escaped text, ``created_at``)."""
    cv = read(spark, sf_dir, "conversations").where(F.col("turn") > 0)
    conv = F.col("conv_id").cast("string")
    return cv.select(
        F.concat(conv, F.lit("-"), F.col("turn").cast("string")).alias("objectID"),
        F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")),
                  F.lit("<"), F.lit("&lt;")).alias("comment_text"),
        F.concat(conv, F.lit("-0")).alias("story_id"),
        F.concat(conv, F.lit("-"), (F.col("turn") - 1).cast("string")).alias("parent_id"),
        iso_utc(_thread_day(F.col("turn")).cast("timestamp_ntz")).alias("created_at"),
    )


def story_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw story hits (objectID, created_at, created_at_i, title, author, _tags)."""
    s = stories(spark, sf_dir)
    return s.select(
        F.col("objectid").alias("objectID"),
        F.col("submission_date").alias("created_at"),
        "created_at_i", "title", "author",
        F.array(F.lit("story"), F.concat(F.lit("author_"), F.col("author")),
                F.concat(F.lit("story_"), F.col("objectid"))).alias("_tags"),
    )


def trend_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension side of the large trend input: (p_partkey, title)."""
    return spread(read(spark, sf_dir, "part"), "p_partkey").select(
        "p_partkey", F.col("p_name").alias("title"))


def trend_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact side of the large trend input: (l_partkey, year_month) per lineitem."""
    li = read(spark, sf_dir, "lineitem")
    return li.select("l_partkey", F.date_format("l_shipdate", "yyyy-MM").alias("year_month"))


def all_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Story and comment hits of one search stream, tagged as the API tags them."""
    from .. import schema

    def full(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns
                           else F.lit(None).cast(f.dataType).alias(f.name)
                           for f in schema.HIT.fields])

    comments = comment_hits(spark, sf_dir).withColumn(
        "_tags", F.array(F.lit("comment"), F.concat(F.lit("story_"), F.col("story_id"))))
    return full(story_hits(spark, sf_dir)).unionByName(full(comments))


def part_vocabulary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A keyword list and a synonym table derived from the part names.

    keywords: every distinct word of ``p_name`` (display name upper-cased,
    ``include_hiring`` for words longer than three letters);
    synonyms: each word of four letters or more maps to itself and its plural
    to it — so the short words are keywords the dictionary does not know (T6).
    """
    words = (read(spark, sf_dir, "part")
             .select(F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
             .where(F.col("w") != "").distinct())
    keywords = words.select(F.col("w").alias("keyword"), F.upper("w").alias("display_name"),
                            (F.length("w") > 3).alias("include_hiring"),
                            F.concat("w", F.lit(".svg")).alias("image_path"))
    long_words = words.where(F.length("w") > 3)
    synonyms = long_words.select(F.col("w").alias("token"), F.col("w").alias("canonical")).unionByName(
        long_words.select(F.concat("w", F.lit("s")).alias("token"), F.col("w").alias("canonical")))
    return keywords, synonyms
