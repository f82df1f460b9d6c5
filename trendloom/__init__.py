"""trendloom — word-trend analytics over discussion-forum data, built on Spark.

Ingest posts and comments incrementally, match a technology vocabulary (with
synonyms) against their text, keep the matches as (word, document) fact
tables, and answer period-by-word questions over them.  Every operator is a
DataFrame-in / DataFrame-out function; nothing is collected to the driver
except bounded dictionaries and argument lists.
"""

__version__ = "0.1.0"
