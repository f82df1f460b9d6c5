"""Keyword x document matching: the (word, document) fact tables.

The product matches each keyword against every document with a text-search
predicate (a lateral cross join).  Here each document is tokenised once and
its match set exploded, then joined to the effective vocabulary on the
canonical word — an equi join, never a cartesian product:

    docs --(match_words: map-only)--> (doc, canonical) --BroadcastHashJoin--> (word, doc)

A size-checked vocabulary (``sources.dictionary``) makes the broadcast bounded and
the whole refresh a single map-only stage per corpus; a vocabulary of any other
size is met by a Bloom filter in that stage and by joins after it.  Facts are unique by (word, document) because the match set of a
document is distinct (A7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PART_SEPARATOR, match_from_chunks, plain_chunks
from ..sources.dictionary import Dictionary, DictionaryTables, any_dictionary

STORY_POSTING_COLUMNS = ("objectid", "submission_date", "title", "year_month")
COMMENT_POSTING_COLUMNS = ("objectid", "year_month")
BLOOM_LOG2 = (12, 26)            # log2 of the bits of the token filter: 512 bytes to 8 MB of bits
MAX_BROADCAST = 250_000          # rows of a lookup that is broadcast, some 100 bytes each


def vocabulary_frame(spark, dictionary: Dictionary, hiring_only: bool = False) -> DataFrame:
    """(word, canonical) of the effective vocabulary, as a tiny DataFrame."""
    rows = sorted(dictionary.effective(hiring_only).items())
    return spark.createDataFrame(rows, "word string, canonical string")


def _chunked(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """(*keep, _chunks): the plain chunks of each document, computed once.

    Tokenising is the CPU-heavy step and runs one task per input partition; an
    under-partitioned corpus should be spread where it is read
    (``operators.partitioning.spread``).
    """
    return docs.select(*keep, plain_chunks(text_col).alias("_chunks"))


def postings(docs: DataFrame, text_col: str, keep: tuple[str, ...],
             dictionary: Dictionary | DictionaryTables, hiring_only: bool = False) -> DataFrame:
    """(word, *keep) for every keyword whose canonical word occurs in ``text_col``.

    The one entry for dictionaries of any size: a bounded one is folded into the
    projection, a larger one is joined (see :func:`postings_by_lookup`).
    """
    if isinstance(dictionary, DictionaryTables):
        return postings_by_lookup(docs, text_col, keep, dictionary, hiring_only)
    d = dictionary.restricted(hiring_only)
    vocab = vocabulary_frame(docs.sparkSession, d, hiring_only)
    matched = _chunked(docs, text_col, keep).select(
        *keep, F.explode(match_from_chunks(F.col("_chunks"), d.synonyms)).alias("canonical"))
    # vocab is bounded by the dictionary size check -> safe to broadcast
    return matched.join(F.broadcast(vocab), "canonical").select("word", *keep)


def token_bitmap(lookup: DataFrame) -> tuple[DataFrame, int]:
    """A Bloom filter of the lookup's tokens as a table (w, bits) of 64-bit words,
    with one hash, and the log2 of its size.

    About 16 bits a token, from ``BLOOM_LOG2[0]`` to ``BLOOM_LOG2[1]``: the table has
    at most 2**(BLOOM_LOG2[1] - 6) rows of 16 bytes (16 MB) and may be broadcast
    whatever the dictionary's size; a fuller one lets more through, no more.
    """
    least, most = BLOOM_LOG2
    size = min(most, max(least, (16 * lookup.count()).bit_length()))
    w, bit = _bloom_cell(F.xxhash64("token"), size)
    words = lookup.select(w.alias("w"), bit.alias("bit")).selectExpr("w", "shiftleft(1L, bit) AS b")
    return words.groupBy("w").agg(F.bit_or("b").alias("bits")), size


def _bloom_cell(h, log2: int):
    cell = F.shiftrightunsigned(h, 64 - log2)
    return F.shiftright(cell, 6), cell.bitwiseAND(F.lit(63)).cast("int")


def _parts(chunks):
    """The parts of a document's compounds, each once."""
    return F.array_distinct(F.flatten(F.transform(F.filter(chunks, lambda c: c.contains("-")),
                                                  lambda c: F.split(c, PART_SEPARATOR))))


def _candidates(chunks, parts):
    """(token, as_chunk, as_part) of a document, each token once: its chunks as they
    stand, and the parts of compounds."""
    def marked(tokens, as_chunk: bool, as_part: bool):
        return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(as_chunk).alias("as_chunk"),
                                                      F.lit(as_part).alias("as_part")))
    return F.concat(marked(F.array_except(chunks, parts), True, False), marked(F.array_intersect(chunks, parts), True, True),
                    marked(F.array_except(parts, chunks), False, True))


def postings_by_lookup(docs: DataFrame, text_col: str, keep: tuple[str, ...], dictionary: DictionaryTables,
                       hiring_only: bool = False) -> DataFrame:
    """:func:`postings` for a dictionary too large to fold into an expression.

    Each row is tokenised once.  Its distinct candidates, chunks and parts of
    compounds, meet a broadcast Bloom filter of the dictionary's tokens in the same
    stage, so that words outside the dictionary are never shuffled.  The others are
    joined to the lookup by token, which stands there once: a lookup of up to
    ``MAX_BROADCAST`` rows is broadcast; for a larger one (or any, where the session
    broadcasts nothing) the candidates are shuffled, and a hot token makes one side of
    that join heavy, which AQE splits.  Only where several tokens stand for one word
    is a row's word sought out again, and only where a word has several keywords does
    another join follow.
    Rows are told apart by a number of their own, not by id: as in the other form,
    rows that repeat an id have facts of their own, and a row has a word once.
    """
    if docs.isStreaming:
        raise ValueError("a stream is matched with a large dictionary batch by batch (streaming.streams)")
    tokens, words, sole = dictionary.meanings(hiring_only)
    bitmap, log2 = token_bitmap(tokens)
    rows = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("_text"))
    if _may_broadcast(docs.sparkSession) and tokens.count() <= MAX_BROADCAST:
        tokens = F.broadcast(tokens)
        if not sole:
            rows = rows.repartition("_row")                  # a row's facts stay together: distinct without a shuffle
    rows = rows.select("_row", *keep, plain_chunks("_text").alias("_chunks"))
    rows = rows.select("_row", *keep, "_chunks", _parts(F.col("_chunks")).alias("_parts"))
    found = rows.select("_row", *keep, F.explode(_candidates(F.col("_chunks"), F.col("_parts"))).alias("c")).select(
        "_row", *keep, "c.token", "c.as_chunk", "c.as_part")
    w, bit = _bloom_cell(F.xxhash64("token"), log2)
    held = (found.withColumn("w", w).withColumn("bit", bit).join(F.broadcast(bitmap), "w")
            .where(F.expr("shiftright(bits, bit) & 1") == 1).drop("w", "bit", "bits"))
    meant = F.array_compact(F.array_distinct(F.array(F.when(F.col("as_chunk"), F.col("whole")),
                                                     F.when(F.col("as_part"), F.col("part")))))
    matched = held.join(tokens, "token").select("_row", *keep, F.explode(meant).alias("word"))
    if not sole:                                             # two tokens of a row may stand for one word
        matched = matched.distinct()
    if words is None:
        return matched.select("word", *keep)
    return matched.withColumnRenamed("word", "canonical").join(words, "canonical").select("word", *keep)


def _may_broadcast(spark) -> bool:
    """Whether the session lets the planner broadcast tables (a negative threshold forbids it)."""
    return not spark.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-")


def postings_by_join(docs: DataFrame, text_col: str, keep: tuple[str, ...],
                     keyword_list: DataFrame, synonyms: DataFrame,
                     hiring_only: bool = False) -> DataFrame:
    """:func:`postings` by joins, whatever the size of the given vocabulary tables."""
    return postings_by_lookup(docs, text_col, keep, DictionaryTables(keyword_list, synonyms), hiring_only)


def postings_for(docs: DataFrame, text_col: str, keep: tuple[str, ...],
                 keyword_list: DataFrame, synonyms: DataFrame,
                 hiring_only: bool = False) -> DataFrame:
    """:func:`postings` with the vocabulary tables in the form that their size allows."""
    dictionary = any_dictionary(keyword_list, synonyms)
    if isinstance(dictionary, DictionaryTables):
        return postings_by_join(docs, text_col, keep, keyword_list, synonyms, hiring_only)
    return postings(docs, text_col, keep, dictionary, hiring_only)


def story_postings(stories: DataFrame, dictionary: Dictionary | DictionaryTables) -> DataFrame:
    """(word, objectid, submission_date, title, year_month) for all keywords."""
    return postings(stories, "title", STORY_POSTING_COLUMNS, dictionary)


def comment_postings(comments: DataFrame, dictionary: Dictionary | DictionaryTables) -> DataFrame:
    """(word, objectid, year_month) for keywords flagged ``include_hiring``."""
    return postings(comments, "comment_text", COMMENT_POSTING_COLUMNS, dictionary, hiring_only=True)


def match_set(docs: DataFrame, text_col: str, keep: tuple[str, ...],
              synonyms: dict[str, str]) -> DataFrame:
    """T5 long form: (*keep, word) for each distinct canonical word of a document."""
    return _chunked(docs, text_col, keep).select(
        *keep, F.explode(match_from_chunks(F.col("_chunks"), synonyms)).alias("word"))
