"""The corpus pipeline: quality, line de-duplication, near-duplicate removal,
benchmark decontamination, packing, each stage written and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), where
``docs`` is what the stage before kept, and all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from trendloom.llm import decontaminate, line_dedup, ngram_join, packing, quality
from trendloom.llm.common import Scratch, read

TOKENIZER = "word_bpe_49k.json"


def good_documents(spark, docs, sf_dir):
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def distinct_lines(spark, docs, sf_dir):
    """Documents without lines that an earlier document has; one that lost lines
    and has no non-blank line left goes."""
    return line_dedup.dedup_lines(docs, gram=line_dedup.SHORT_GRAM, drop_emptied=True)


def one_per_group(spark, docs, sf_dir):
    """The first row of each group of linked ones, by id, then by the text's hash.

    A row is addressed by (id, hash of its text), so that rows which share an id with
    another text are judged by their own; of rows that repeat both, one stays.  Rows
    without a word link with nothing and all stay.
    """
    tag = uuid.uuid4().hex[:8]                                    # names that cannot clash
    row = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    groups = Scratch(spark, "groups").save(
        ngram_join.ngram_components(docs.select(row.alias("doc_id"), "text")).where("n_shingles > 0"), "groups")
    places = groups.groupBy("doc_id").agg(F.min("component_id").alias("first"), F.count("*").alias("n"))
    # the few rows that go, or of which one is chosen, are all that is joined
    marked = places.where("doc_id <> first or n > 1").select(
        F.col("doc_id.id").alias(f"id_{tag}"), F.col("doc_id.h").alias(f"h_{tag}"),
        (F.col("doc_id") == F.col("first")).alias(f"first_{tag}"))
    marked = Scratch(spark, "groups").save(marked, "marked")
    here = docs["doc_id"].eqNullSafe(F.col(f"id_{tag}")) & (F.xxhash64(docs["text"]) == F.col(f"h_{tag}"))
    once = docs.join(marked, here, "left_anti")
    repeated = docs.join(marked.where(f"first_{tag}").select(f"id_{tag}", f"h_{tag}"), here)
    chosen = repeated.groupBy(f"id_{tag}", f"h_{tag}").agg(F.first(F.struct(*(docs[c] for c in docs.columns))).alias("r"))
    return once.unionByName(chosen.select("r.*"))


def clean_of_benchmark(spark, docs, sf_dir):
    """Documents that share no passage with a benchmark item."""
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def packed(spark, docs, sf_dir):
    """Token sequences: one row per piece of a document."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", good_documents), ("line_dedup", distinct_lines), ("ngram_join", one_per_group),
          ("decontaminate", clean_of_benchmark), ("packing", packed)]

#: The classifier's training and the tokenizer are beyond SQL; the stages are
#: tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to ``documents``; the last one's rows."""
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
