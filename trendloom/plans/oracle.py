"""ANSI/DuckDB SQL equivalents of the registered queries (the correctness oracle).

The matching rules (T1-T5) are written relationally here — unnest the chunks,
join the synonym table, split compounds — so the oracle is an independent
formulation of the same specification as the Spark column expressions.
"""

from __future__ import annotations

from ..sources.dictionary import Dictionary
from . import fixtures as fx


# Fixed values, written out here so that the oracle does not lean on the patterns it checks.
TERM_REPLACEMENTS = (("f#", "fsharp"), ("c#", "csharp"), ("c++", "cpp"))
TAG = "<[/!?]?[a-z][^>]*>"
URL = "https?://[^ \\t\\n\\x0B\\f\\r]+"
CHUNK = "(?:~?/)?[\\p{L}\\p{N}]+(?:[-./@]+[\\p{L}\\p{N}]+)*"
SEPARATOR = "-+"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows, cols) -> str:
    if not rows:
        nulls = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in cols)
        return f"(SELECT {nulls} WHERE FALSE)"
    body = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(cols)}))"


def iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def epoch(expr: str) -> str:
    return f"CAST(epoch({expr}) AS BIGINT)"


def normalize_sql(expr: str) -> str:
    out = f"lower({expr})"
    for search, repl in TERM_REPLACEMENTS:
        out = f"replace({out}, {q(search)}, {q(repl)})"
    return out


def chunks_sql(expr: str) -> str:
    cleaned = f"regexp_replace({normalize_sql(expr)}, {q(TAG)}, ' ', 'g')"
    cleaned = f"regexp_replace({cleaned}, {q(URL)}, ' ', 'g')"
    return f"regexp_extract_all({cleaned}, {q(CHUNK)})"


def match_sql(source: str, keys: list[str], text: str, synonyms: dict[str, str]) -> str:
    """SELECT DISTINCT keys..., canonical — the T5 match set of each row of ``source``."""
    k = ", ".join(keys)
    syn = values(sorted(synonyms.items()), ["token", "canonical"])
    return f"""
SELECT DISTINCT {k}, canonical FROM (
  SELECT {k}, s.canonical FROM (
    SELECT {k}, c FROM (SELECT {k}, unnest({chunks_sql(text)}) AS c FROM ({source}) src0)
    WHERE NOT (contains(c, '.') OR contains(c, '/') OR contains(c, '@'))
  ) t JOIN {syn} s ON t.c = s.token
  UNION ALL
  SELECT {k}, p AS canonical FROM (
    SELECT {k}, unnest(string_split_regex(c, {q(SEPARATOR)})) AS p FROM (
      SELECT {k}, c FROM (SELECT {k}, unnest({chunks_sql(text)}) AS c FROM ({source}) src1)
      WHERE NOT (contains(c, '.') OR contains(c, '/') OR contains(c, '@')) AND contains(c, '-')
    ) t2
  ) t3 WHERE p IN (SELECT canonical FROM {syn} s2)
) m"""


def postings_sql(source: str, keys: list[str], text: str, dictionary: Dictionary,
                 hiring_only: bool = False, extra: list[str] | None = None) -> str:
    """(word, keys..., extra...) — T7/T8: matches joined to the effective vocabulary."""
    eff = sorted(dictionary.effective(hiring_only).items())
    vocab = values(eff, ["word", "canonical"])
    extra = extra or []
    m = match_sql(source, keys, text, dictionary.synonyms)
    sel = ", ".join([f"m.{c}" for c in keys] + [f"src.{c}" for c in extra])
    join_src = ""
    if extra:
        on = " AND ".join(f"src.{c} = m.{c}" for c in keys)
        join_src = f" JOIN ({source}) src ON {on}"
    return (f"SELECT v.word AS word, {sel} FROM ({m}) m JOIN {vocab} v "
            f"ON v.canonical = m.canonical{join_src}")


# ---- fixture views ---------------------------------------------------------------

STORIES = f"""
SELECT CAST(o_orderkey AS VARCHAR) AS objectid,
       {iso('o_orderdate')} AS submission_date,
       {epoch('o_orderdate')} AS created_at_i,
       lower(c_mktsegment) || ' ' || o_orderpriority AS title,
       c_name AS author,
       substr({iso('o_orderdate')}, 1, 7) AS year_month
FROM orders JOIN customer ON o_custkey = c_custkey"""


def _day(base: str, offset: str) -> str:
    return f"CAST(DATE {q(base)} + CAST({offset} AS INTEGER) AS TIMESTAMP)"


_DOC_DAY = _day(fx.THREAD_EPOCH, "doc_id * 7 % 1800")
DOC_STORIES = f"""
SELECT CAST(doc_id AS VARCHAR) AS objectid,
       {iso(_DOC_DAY)} AS submission_date,
       {epoch(_DOC_DAY)} AS created_at_i,
       text AS title, source AS author,
       substr({iso(_DOC_DAY)}, 1, 7) AS year_month
FROM documents"""

_COMMENT_DAY = _day(fx.THREAD_EPOCH, "conv_id * 11 % 1800 + turn")
HIRING_COMMENTS = f"""
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS objectid,
       text AS comment_text,
       CAST(conv_id AS VARCHAR) || '-0' AS storyid,
       CAST(conv_id AS VARCHAR) || '-' || CAST(turn - 1 AS VARCHAR) AS parentid,
       {iso(_COMMENT_DAY)} AS created_date,
       (turn - 1 = 0) AS is_toplevel_comment,
       substr({iso(_COMMENT_DAY)}, 1, 7) AS year_month
FROM conversations WHERE turn > 0"""

_THREAD_DAY = _day(fx.THREAD_EPOCH, "conv_id * 11 % 1800")
HIRING_THREADS = f"""
SELECT CAST(conv_id AS VARCHAR) || '-0' AS objectid,
       {iso(_THREAD_DAY)} AS submission_date,
       {epoch(_THREAD_DAY)} AS created_at_i,
       text AS title, role AS author,
       substr({iso(_THREAD_DAY)}, 1, 7) AS year_month
FROM conversations WHERE turn = 0"""

THREAD_LOG = f"SELECT objectid FROM ({HIRING_THREADS}) t WHERE submission_date < {q(fx.THREAD_LOG_BEFORE)}"
STORY_LOG = "SELECT CAST(o_orderkey AS VARCHAR) AS objectid FROM orders WHERE o_orderstatus = 'F'"

TREND_PARTS = "SELECT p_partkey, p_name AS title FROM part"
TREND_PERIODS = "SELECT l_partkey, strftime(l_shipdate, '%Y-%m') AS year_month FROM lineitem"


def current_period(as_of: str) -> str:
    return as_of[:7]


def pivot_sql(long_sql: str, words: list[str], value: str) -> str:
    ws = sorted(set(words))
    cols = ", ".join(f"CAST(COALESCE(SUM({value}) FILTER (WHERE word = {q(w)}), 0) AS BIGINT) AS \"{w}\""
                     for w in ws)
    return f"SELECT year_month, {cols} FROM ({long_sql}) l GROUP BY year_month"
