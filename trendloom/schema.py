"""Table schemas (S9): explicit StructTypes, never inferred.

``created_at_i`` is widened from 32-bit to LongType on purpose (2038).
``year_month`` and ``is_toplevel_comment`` are derived columns computed once at
ingest and stored (see ``operators.ingest``).
"""

from __future__ import annotations

from pyspark.sql import types as T

STORIES = T.StructType([
    T.StructField("objectid", T.StringType(), False),
    T.StructField("submission_date", T.StringType(), False),
    T.StructField("created_at_i", T.LongType(), False),
    T.StructField("title", T.StringType(), True),
    T.StructField("author", T.StringType(), True),
    T.StructField("year_month", T.StringType(), True),
])

HIRING_COMMENTS = T.StructType([
    T.StructField("objectid", T.StringType(), False),
    T.StructField("comment_text", T.StringType(), False),
    T.StructField("storyid", T.StringType(), False),
    T.StructField("parentid", T.StringType(), False),
    T.StructField("created_date", T.StringType(), False),
    T.StructField("is_toplevel_comment", T.BooleanType(), True),
    T.StructField("year_month", T.StringType(), True),
])

KEYWORD_LIST = T.StructType([
    T.StructField("keyword", T.StringType(), True),
    T.StructField("display_name", T.StringType(), True),
    T.StructField("include_hiring", T.BooleanType(), True),
    T.StructField("image_path", T.StringType(), True),
])

SYNONYMS = T.StructType([
    T.StructField("token", T.StringType(), False),
    T.StructField("canonical", T.StringType(), False),
])

HIRING_POSTS_LOG = T.StructType([
    T.StructField("objectid", T.StringType(), False),
    T.StructField("processed_date", T.TimestampType(), True),
])

KEYWORDS = T.StructType([
    T.StructField("word", T.StringType(), False),
    T.StructField("objectid", T.StringType(), False),
    T.StructField("submission_date", T.StringType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("year_month", T.StringType(), True),
])

HIRING_KEYWORDS = T.StructType([
    T.StructField("word", T.StringType(), False),
    T.StructField("objectid", T.StringType(), False),
    T.StructField("year_month", T.StringType(), True),
])

# Raw search hits as delivered by the forum's search API (one JSON object per
# hit inside a ``hits`` array).  Ids arrive as JSON numbers *or* strings, so
# they are read as strings.
HIT = T.StructType([
    T.StructField("objectID", T.StringType(), True),
    T.StructField("created_at", T.StringType(), True),
    T.StructField("created_at_i", T.LongType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("author", T.StringType(), True),
    T.StructField("comment_text", T.StringType(), True),
    T.StructField("story_id", T.StringType(), True),
    T.StructField("parent_id", T.StringType(), True),
    T.StructField("_tags", T.ArrayType(T.StringType()), True),
])

HITS_ENVELOPE = T.StructType([
    T.StructField("hits", T.ArrayType(HIT), True),
])

# Primary keys and NOT NULL columns of each table (used by the constraint audit).
KEYS = {
    "stories": ["objectid"],
    "hiring_comments": ["objectid"],
    "hiring_posts_log": ["objectid"],
    "keywords": ["word", "objectid"],
    "hiring_keywords": ["word", "objectid"],
}

REQUIRED = {
    "stories": ["objectid", "submission_date", "created_at_i"],
    "hiring_comments": ["objectid", "comment_text", "storyid", "parentid", "created_date"],
    "hiring_posts_log": ["objectid"],
    "keywords": ["word", "objectid"],
    "hiring_keywords": ["word", "objectid"],
}

# Date columns, which must start like an ISO date (their month is a partition).
DATES = {"stories": ["submission_date"], "hiring_comments": ["created_date"]}
ISO_DATE = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"

SCHEMAS = {
    "stories": STORIES,
    "hiring_comments": HIRING_COMMENTS,
    "keyword_list": KEYWORD_LIST,
    "hiring_posts_log": HIRING_POSTS_LOG,
    "keywords": KEYWORDS,
    "hiring_keywords": HIRING_KEYWORDS,
}

# Partition column of each stored table: facts by word (point lookups by word
# prune to one folder), base tables by period.  Inside a partition, rows are
# written sorted by SORT_COLUMNS so Parquet row-group min/max statistics skip
# row groups for period filters (the product's (word, year_month) index).
PARTITION_COLUMNS = {
    "stories": ["year_month"],
    "hiring_comments": ["year_month"],
    "keywords": ["word"],
    "hiring_keywords": ["word"],
}

SORT_COLUMNS = {
    "stories": ["created_at_i"],
    "hiring_comments": ["created_date"],
    "keywords": ["year_month"],
    "hiring_keywords": ["year_month"],
}
