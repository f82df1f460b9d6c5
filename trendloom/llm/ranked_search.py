r"""Ranked lexical search by the Best Position Algorithm, exact.

Terms are the maximal runs of ASCII letters and digits and of characters beyond
ASCII, with A-Z lower-cased.  A document's score for an item sums, over the item's
terms with repeats, ``w * ((10^9 tf) div (1000 tf + 12 m))`` with the term's weight
``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` and the document's length norm
``m = 75 + (25 n N) div L``: N documents with a term hold L terms, this one n.

1. One pass over the texts writes a forward table: per document n, and the
   items' terms that it holds with their counts.  N, L and every df come from it.
2. Each task cuts its documents into shards.  A shard has an *impact list* per term,
   its documents by descending summand, and an index of positions by term and
   document for direct accesses.
3. For each item, the lists are read from their first unseen positions on.  A
   document met there is looked up in all lists, which gives its score and marks its
   position in each as seen.  A list's *best position* is the last one up to which
   all are seen, whether they were read or looked up; no document not met yet has a
   larger summand than the next one.  Their sum is the threshold, and the item is
   done when it is strictly below the k-th score (a tie might still rank higher).

The k-th scores of a share of the documents, found first, are lower bounds of the
final ones; shards stop below them and return only what reaches them.

Items are searched in blocks of bounded text, so that a block's terms may be sent to
all tasks: a large set of items means more passes, not a larger broadcast.

Edge cases: texts without a term (null, empty) count in neither N nor L and are never
found; items without a term that occurs find nothing; equal scores rank by ascending
id, null ids last; repeated documents rank each, repeated items are answered each;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, in_slices, list_array

K = 20
BLOCK_CHARACTERS = 4_000_000     # of items' text searched together
SHARD, CELLS = 8192, 1 << 25     # documents of a shard at most; entries of its position index
FIRST_SHARE = 32                 # one document in so many gives the first bounds
_SALTS = 64
_FIRST_READS = 64                # entries read of each list at once, doubled from step to step

#: What separates terms, 00-2F 3A-40 5B-60 7B-7F.
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(_SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(_SEPARATORS) + bytes(range(0x61, 0x7B)))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Shard:
    """Impact lists of some documents: per term, descending summands."""

    def __init__(self, weights: np.ndarray, terms: np.ndarray, places: np.ndarray, tf: np.ndarray, norms: np.ndarray):
        impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * norms[places]))
        order = np.argsort((terms << 36) - impact, kind="stable")    # summands are below 2^36
        order = order[impact[order] > 0]
        self.impacts, self.places = impact[order], places[order]
        term = terms[order]
        self.starts = np.searchsorted(term, np.arange(len(weights) + 1))
        self.size = len(norms)
        self.positions = np.full((len(weights), self.size), -1, dtype=np.int16 if self.size < 1 << 15 else np.int32)
        self.positions[term, self.places] = np.arange(len(term)) - self.starts[term]

    def best(self, terms: np.ndarray, times: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) that hold the shard's k best documents of those that
        score ``least`` (1 at least) or more, and perhaps others."""
        start, length = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        some = length > 0
        terms, times, start, length = terms[some], times[some], start[some], length[some]
        base = np.concatenate(([0], np.cumsum(length)))
        seen = np.zeros(base[-1] + 1, dtype=bool)                    # the last one stays unseen
        at = np.zeros(len(terms), dtype=np.int64)                    # the best positions, as first unseen ones
        found, scores = [np.empty(0, np.int64)], np.empty(0, np.int64)
        reads = _FIRST_READS
        while True:
            ahead = at < length
            threshold = int((times[ahead] * self.impacts[start[ahead] + at[ahead]]).sum())
            if threshold < least or not ahead.any():
                return np.concatenate(found), scores
            read = at[:, None] + np.arange(reads)
            row, col = np.nonzero(read < length[:, None])
            read = read[row, col]
            new = ~seen[base[row] + read]
            places = np.unique(self.places[start[row[new]] + read[new]])
            there = self.positions[np.ix_(terms, places)].astype(np.int64)   # direct accesses
            held = there >= 0
            seen[(base[:-1, None] + there)[held]] = True
            score = times @ np.where(held, self.impacts[np.where(held, start[:, None] + there, 0)], 0)
            high = score >= least
            found.append(places[high])
            scores = np.concatenate((scores, score[high]))
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            for i in np.flatnonzero(ahead):
                rest = seen[base[i] + at[i]:base[i + 1]]
                step = int(rest.argmin())
                at[i] += step if not rest[step] else len(rest)
            reads *= 2


def _forward(docs: DataFrame, vocabulary: dict[bytes, int], kind: str) -> DataFrame:
    """Per document: doc_id, n, the vocabulary's terms in it and their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)    # terms of a block of items

    def run(batches):
        known = shared.value
        for batch in batches:
            sizes, terms, counts = [], [], []
            for texts in in_slices(batch):
                for text in texts:
                    words = terms_of(text)
                    held = Counter(words)
                    hits = held.keys() & known.keys()
                    sizes.append(len(words))
                    terms.append(np.fromiter((known[w] for w in hits), np.int32, len(hits)))
                    counts.append(np.fromiter((held[w] for w in hits), np.int64, len(hits)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), list_array(terms, pa.int32()),
                 list_array(counts, pa.int64())], names=["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, counts array<long>")


def _document_counts(forward: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term."""
    def run(batches):
        total = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], names=["term", "df"])

    rows = forward.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(terms, dtype=np.int64)
    table = rows.toArrow()                                           # a row for each term of the block
    out[table.column("term").to_numpy()] = table.column("df").to_numpy()
    return out


def _search(forward: DataFrame, kind: str, weights: np.ndarray, items: list[tuple[np.ndarray, np.ndarray]],
            documents: int, total: int, k: int, bounds: np.ndarray) -> DataFrame:
    """(item, doc_id, score): of every task, each item's k best documents that
    reach its bound."""
    shared = forward.sparkSession.sparkContext.broadcast((weights, items, bounds))
    shard = int(min(SHARD, max(64, CELLS // max(1, len(weights)))))
    shard_rows = forward.where(F.size("terms") > 0)

    def run(batches):
        w, wanted, least = shared.value
        best: list[list] = [[] for _ in wanted]
        key_type = None
        for whole in batches:
            key_type = whole.schema.field("doc_id").type
            for begin in range(0, whole.num_rows, shard):
                batch = whole.slice(begin, shard)
                lists = batch.column("terms")
                sizes = np.diff(lists.offsets.to_numpy())
                n = batch.column("n").to_numpy()
                index = Shard(w, lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(n)), sizes),
                              batch.column("counts").flatten().to_numpy(), 75 + (25 * n * documents) // total)
                ids = batch.column("doc_id")
                for i, (terms, times) in enumerate(wanted):
                    kth = -best[i][-1][0] if len(best[i]) == k else 1
                    places, scores = index.best(terms, times, max(1, kth, int(least[i])), k)
                    if len(places):
                        keys = ids.take(pa.array(places)).to_pylist()
                        best[i] = sorted(best[i] + [(-s, d is None, d) for s, d in zip(scores.tolist(), keys)],
                                         key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))[:k]
        rows = [(i, d, -s) for i, top in enumerate(best) for s, _, d in top]
        if not rows:
            return
        at, keys, scores = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(keys, key_type),
                                          pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return shard_rows.mapInArrow(run, f"item int, doc_id {kind}, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item, from many tasks: by parts first."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = Window.partitionBy("item", F.pmod(F.hash("doc_id"), F.lit(_SALTS))).orderBy(*order)
    few = found.withColumn("at", F.row_number().over(part)).where(F.col("at") <= k).drop("at")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(
        F.col("rank") <= k)


def top_documents(docs: DataFrame, items: DataFrame, *, k: int = K, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents above 0."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranked")
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    asked = scratch.save(items.groupBy(F.col(item_key).alias("item_id"), F.col(item_text).cast("string").alias("text"))
                         .agg(F.count("*").alias("times")), "items")
    characters = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-characters // BLOCK_CHARACTERS))
    parts = [_block(scratch, docs, asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b), kind, k, b)
             for b in range(blocks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select(F.col("item_id").alias(item_key), "rank", F.col("doc_id").alias(key), "score")


def _block(scratch: Scratch, docs: DataFrame, asked: DataFrame, kind: str, k: int, block: int) -> DataFrame:
    rows = asked.collect()                                           # of BLOCK_CHARACTERS
    counted = [Counter(terms_of(r["text"] or "")) for r in rows]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*counted)))}
    wanted = [(np.array([vocabulary[w] for w in c], np.int64), np.array(list(c.values()), np.int64)) for c in counted]
    forward = scratch.save(_forward(docs, vocabulary, kind), f"forward-{block}")
    sums = forward.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("total")).first()
    documents, total = sums["n"], sums["total"] or 1
    df = _document_counts(forward, len(vocabulary))
    weights = np.array([weight(documents, int(x)) for x in df], np.int64)
    none = np.zeros(len(wanted), np.int64)
    first = forward.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST_SHARE)) == 0)
    bounds = none.copy()
    kth = _ranked(_search(first, kind, weights, wanted, documents, total, k, none), k).where(F.col("rank") == k)
    for r in kth.select("item", "score").collect():                  # a row for each item of the block
        bounds[r["item"]] = r["score"]
    found = scratch.save(_search(forward, kind, weights, wanted, documents, total, k, bounds), f"found-{block}")
    names = docs.sparkSession.createDataFrame(
        [(i, r["item_id"], r["times"]) for i, r in enumerate(rows)],
        f"number int, item_id {dict(asked.dtypes)['item_id']}, times long")
    ranked = _ranked(found, k)
    return ranked.join(F.broadcast(names), ranked["item"] == names["number"]).select(
        "item_id", "rank", "doc_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy")).drop("copy")
