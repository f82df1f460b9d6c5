"""Registered queries of the llm operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import (cover_tree, decontaminate, language_id, line_dedup, merkle, near_dup, ngram_join, packing, quality,
               ranked_search, secret_scan, toxicity, url_filter)
from .common import fold, read

TOKENIZER = "word_bpe_49k.json"

#: The URL rules (verdict, host, path).
URL_RULES = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"),
             url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]

#: Fixed value: a term of the ranked search.
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def op1_decontaminate(spark, sf_dir):
    return decontaminate.find_overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_quality(spark, sf_dir):
    return quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_cover_tree(spark, sf_dir):
    return cover_tree.top_k(read(spark, sf_dir, "embeddings"))


def op4_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_language(spark, sf_dir):
    return language_id.identify(read(spark, sf_dir, "documents"))


def op6_url_filter(spark, sf_dir):
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op7_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_line_dedup(spark, sf_dir):
    """doc_id, the text without repeated lines, lines before, lines removed."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, gram=line_dedup.SHORT_GRAM, counts=("n_lines", "n_removed"))


def op9_ngram_join(spark, sf_dir):
    return ngram_join.ngram_components(read(spark, sf_dir, "documents"))


def op10_secrets(spark, sf_dir):
    return secret_scan.scan_secrets(read(spark, sf_dir, "documents"))


def op11_minhash_dedup(spark, sf_dir):
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark, sf_dir):
    """The manifest, and what its proofs say once every second row (by the crc32
    of its id) has lost its line ends."""
    altered = F.when(fold("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.check_manifest(read(spark, sf_dir, "documents"), {"text": altered})


def op13_ranked_search(spark, sf_dir):
    return ranked_search.top_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {f.__name__: f for f in (
        op1_decontaminate, op2_quality, op3_cover_tree, op4_toxicity, op5_language, op6_url_filter,
        op7_packing, op8_line_dedup, op9_ngram_join, op10_secrets,
        op11_minhash_dedup, op12_merkle_manifest, op13_ranked_search, pipeline)}


def oracle_sql():
    """DuckDB SQL where it can express the query."""
    rules = "\n".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'"
        for r in sorted(URL_RULES, key=lambda r: -len(r.text)))
    verdicts = "\n".join(f"WHEN rule = '{r.text}' THEN '{r.verdict}'" for r in URL_RULES)
    return {
        "op3_cover_tree": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
        "op6_url_filter": rf"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
h AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM p),
r AS (
  SELECT *, CASE {rules} END AS rule FROM h)
SELECT page_id, host, path, rule, CASE {verdicts} ELSE 'allow' END AS verdict FROM r""",
        "op12_merkle_manifest": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, lang, n_chars, text,
         CASE WHEN list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1),
                   lambda p: ascii(substr(doc_id::VARCHAR, p, 1))::BIGINT)),
                 lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
                   lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) & 1 = 1
              THEN replace(text, chr(10), '') ELSE text END AS altered
  FROM documents),
e AS (
  SELECT rid, doc_id, source, altered, text,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM d),
f AS (
  SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(altered) || ':' || altered, '-')) AS test FROM e),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS c FROM f),
up AS (
  SELECT 0 AS level, g, i, c, leaf AS h FROM leaves
  UNION ALL
  SELECT level + 1, g, i // 3, (any_value(c) + 2) // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM up WHERE c > 1 GROUP BY level, g, i // 3),
subroots AS (SELECT g, h FROM up WHERE c = 1),
top AS (
  SELECT 0 AS level, g AS i, (SELECT count(*) FROM subroots) AS c, h FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (any_value(c) + 2) // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM top WHERE c > 1 GROUP BY level, i // 3),
sides AS (
  SELECT n.level, n.g, n.i, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < n.i), '') AS l,
         coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > n.i), '') AS r
  FROM up n JOIN up s ON n.level = s.level AND n.g = s.g AND n.i // 3 = s.i // 3 WHERE n.c > 1 GROUP BY ALL),
top_sides AS (
  SELECT n.level, n.i, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < n.i), '') AS l,
         coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > n.i), '') AS r
  FROM top n JOIN top s ON n.level = s.level AND n.i // 3 = s.i // 3 WHERE n.c > 1 GROUP BY ALL),
walk AS (
  SELECT rid, g, 0 AS level, i, test AS h, '' AS proof, 0 AS part FROM leaves
  UNION ALL
  SELECT w.rid, w.g, CASE WHEN s.l IS NOT NULL OR w.part = 1 THEN w.level + 1 ELSE 0 END,
         CASE WHEN s.l IS NOT NULL OR w.part = 1 THEN w.i // 3 ELSE w.g END,
         CASE WHEN s.l IS NOT NULL THEN sha256(s.l || w.h || s.r) WHEN w.part = 1 THEN sha256(t.l || w.h || t.r) ELSE w.h END,
         w.proof || CASE WHEN s.l IS NOT NULL THEN s.l || s.r WHEN w.part = 1 THEN t.l || t.r ELSE '' END,
         CASE WHEN s.l IS NOT NULL OR w.part = 1 THEN w.part ELSE 1 END
  FROM walk w LEFT JOIN sides s ON w.part = 0 AND w.level = s.level AND w.g = s.g AND w.i = s.i
       LEFT JOIN top_sides t ON w.part = 1 AND w.level = t.level AND w.i = t.i
  WHERE w.part = 0 OR t.l IS NOT NULL),
ends AS (
  SELECT rid, arg_max(h, level) AS folded, sha256(arg_max(proof, level)) AS proof FROM walk WHERE part = 1 GROUP BY rid),
root AS (SELECT h AS root FROM top WHERE c = 1)
SELECT doc_id, leaf, s.h AS subroot, root, proof AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM leaves JOIN subroots s USING (g) JOIN ends USING (rid), root""",
        "op13_ranked_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{terms}') AS ts FROM documents),
q AS (
  SELECT row_number() OVER () AS qid, item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{terms}') AS ts FROM benchmark),
stats AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d WHERE len(ts) > 0),
tf AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), stats),
m AS (
  SELECT rid, doc_id, 75 + (25 * len(ts) * docs) // total AS m FROM d, stats WHERE len(ts) > 0),
s AS (
  SELECT qid, item_id, rid, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM (SELECT qid, item_id, term, count(*) AS times FROM (SELECT qid, item_id, unnest(ts) AS term FROM q) GROUP BY ALL)
       JOIN tf USING (term) JOIN w USING (term) JOIN m USING (rid)
  GROUP BY qid, item_id, rid, doc_id),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""".replace("{terms}", TERMS),
    }
