r"""Benchmark decontamination by spaced seeds.

Texts become word sequences (``\w+``, lower case).  A spaced seed looks at the
care positions of a fixed mask and ignores the others, so that a passage with
single words replaced still has seeds without a replaced word.  Seeds of the
benchmark and of the documents are hashed and equi-joined; each hit gives a
diagonal, along which document and item are compared word by word.  A segment of
at least ``min_words`` words, or of 80 % of a shorter item, at least 80 % of them
equal, is an overlap: the best-scoring one (matching words count 1, replaced ones
-3), else the whole item, else the longest such run between two equal words.

A fixed bitmap of the benchmark's seed hashes screens the documents' seeds on
the scan; the stretches of words around what passes are written as *regions*,
and only their seeds are shuffled.  The benchmark is never broadcast.

Edge cases: null or empty texts (on either side) overlap with nothing; items of
fewer words than the shortest mask are compared as one seed of all their words;
items with equal words are compared once and reported each; repeated rows are
reported once per (id, item); rows with a null id are reported with that null;
an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fixed_bitmap, in_bitmap, list_array, texts_of
from .hashing import MULTIPLIERS, WordHashes, mix, signed, tag

#: Masks of weight 6: 1 looks at a word, 0 ignores it.
MASKS = ("111111", "11010111", "1101001011", "1011001101", "110010100101")
MIN_WORDS = 12
LEAST_EQUAL = 0.8
MISMATCH = 3                     # what a replaced word costs, in matching ones
AROUND = 32                      # words kept on either side of a seed

_WORD = re.compile(r"\w+")
_OFFSETS = [np.flatnonzero(np.frombuffer(m.encode(), dtype=np.uint8) == ord("1")) for m in MASKS]
_SHORTEST = min(map(len, MASKS))


def word_hashes(words: WordHashes, text: str) -> np.ndarray:
    return words.of([w.encode("utf-8", "replace") for w in _WORD.findall(text.lower())])


def seeds(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words spanned, hash) of all seeds of a word sequence."""
    starts, spans, hashes = [], [], []
    for i, (mask, offsets) in enumerate(zip(MASKS, _OFFSETS)):
        count = len(w) - len(mask) + 1
        if count <= 0:
            continue
        h = np.full(count, tag(i + 1, 62))
        for j, o in enumerate(offsets):
            h += w[o:o + count] * MULTIPLIERS[j]
        starts.append(np.arange(count, dtype=np.int32))
        spans.append(np.full(count, len(mask), dtype=np.int32))
        hashes.append(mix(h))
    if not starts:
        return np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(spans), np.concatenate(hashes)


def short_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, n below the shortest mask."""
    count = len(w) - n + 1
    if count <= 0 or n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(count, tag(100 + n, 62))
    for j in range(n):
        h += w[j:j + count] * MULTIPLIERS[j]
    return mix(h)


def best_segment(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal words) of the best-scoring run of a diagonal."""
    if not equal.any():
        return 0, 0, 0
    total = np.concatenate(([0], np.cumsum(np.where(equal, 1, -MISMATCH))))
    low = np.minimum.accumulate(total)
    end = int((total - low).argmax())
    start = int(np.flatnonzero(total[:end + 1] == low[end])[-1])
    return start, end, int(equal[start:end].sum())


def longest_run(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal words) of the longest run of a diagonal that starts and
    ends with an equal word and has at least LEAST_EQUAL of its words equal."""
    if not equal.any():
        return 0, 0, 0
    total = np.concatenate(([0], np.cumsum(np.where(equal, 1, -4))))         # 4 equal words for a replaced one
    low = np.minimum.accumulate(np.where(equal, total[:-1], len(equal) + 1))
    ends = np.flatnonzero(equal) + 1
    starts = np.searchsorted(-low, -total[ends], side="left")                # the first from which it is not less
    at = int((ends - starts).argmax())
    start, end = int(starts[at]), int(ends[at])
    return start, end, int(equal[start:end].sum())


def overlap(equal: np.ndarray, item_words: int, min_words: int = MIN_WORDS) -> tuple[int, int, int] | None:
    """(start, end, equal words) of the overlap on a diagonal, if there is one."""
    found = best_segment(equal)
    if is_overlap(found[1] - found[0], found[2], item_words, min_words):
        return found
    if len(equal) == item_words:
        found = 0, item_words, int(equal.sum())
        if is_overlap(item_words, found[2], item_words, min_words):
            return found
    found = longest_run(equal)
    return found if is_overlap(found[1] - found[0], found[2], item_words, min_words) else None


def is_overlap(length: int, equal: int, item_words: int, min_words: int = MIN_WORDS) -> bool:
    needed = min_words if item_words >= min_words else max(1, -(-4 * item_words // 5))
    return length >= needed and equal >= LEAST_EQUAL * length


def _items(scratch: Scratch, benchmark: DataFrame, item: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, words per distinct item text, seeds per distinct item text)."""
    rows = benchmark.select(F.col(item).alias("item_id"), F.col(text).cast("string").alias("text"))
    kind = dict(rows.dtypes)["item_id"]

    def hashed(batches):
        words = WordHashes()
        for batch in batches:
            w = [word_hashes(words, t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array([xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in w],
                                                   pa.int64()), list_array([signed(x) for x in w], pa.int64())],
                names=["item_id", "c", "words"])

    items = scratch.save(rows.mapInArrow(hashed, f"item_id {kind}, c long, words array<long>")
                         .where("size(words) > 0"), "items")
    distinct = scratch.save(items.groupBy("c").agg(F.first("words").alias("words")), "distinct")

    def seeded(batches):
        for batch in batches:
            c, pos, hashes = [], [], []
            for k, w in zip(batch.column("c").to_pylist(), batch.column("words")):
                w = w.values.to_numpy().view(np.uint64)
                starts, _, h = seeds(w)
                if len(w) < _SHORTEST:
                    starts, h = np.zeros(1, np.int32), short_hashes(w, len(w))
                c.append(np.full(len(h), k))
                pos.append(starts)
                hashes.append(signed(h))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (c, pos, hashes)], names=["c", "ipos", "h"])

    made = distinct.mapInArrow(seeded, "c long, ipos int, h long")
    return items.select("item_id", "c"), distinct, scratch.save(made, "seeds")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per contaminated (document, item): doc_id, item_id, doc_start,
    item_start, n_words, n_equal of the longest overlap (word positions)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items, distinct, bench_seeds = _items(scratch, benchmark, item, item_text)
    short = sorted(r["n"] for r in distinct.where(F.size("words") < _SHORTEST)
                   .select(F.size("words").alias("n")).distinct().collect())      # fewer than six rows
    wanted = spark.sparkContext.broadcast((                      # two probes of different bits: 4 MB
        fixed_bitmap(bench_seeds, "h"), fixed_bitmap(bench_seeds.select(F.shiftleft("h", 24).alias("h")), "h")))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def regions(batches):
        words, (first, second) = WordHashes(), wanted.value
        for batch in batches:
            row, begins, kept, hit_pos, hit_hash = [], [], [], [], []
            for i, t in enumerate(texts_of(batch)):
                w = word_hashes(words, t)
                starts, spans, h = seeds(w)
                for n in short:
                    more = short_hashes(w, n)
                    starts = np.concatenate((starts, np.arange(len(more), dtype=np.int32)))
                    spans = np.concatenate((spans, np.full(len(more), n, np.int32)))
                    h = np.concatenate((h, more))
                found = np.flatnonzero(in_bitmap(first, h))
                found = found[in_bitmap(second, h[found] << np.uint64(24))]
                if not len(found):
                    continue
                found = found[np.argsort(starts[found], kind="stable")]
                at, end = starts[found], starts[found] + spans[found]
                # seeds whose surroundings touch share a region
                cut = np.flatnonzero(at[1:] - AROUND > np.maximum.accumulate(end)[:-1] + AROUND) + 1
                for part in np.split(np.arange(len(found)), cut):
                    lo, hi = max(0, int(at[part[0]]) - AROUND), int(end[part].max()) + AROUND
                    row.append(i)
                    begins.append(lo)
                    kept.append(signed(w[lo:hi]))
                    hit_pos.append((at[part] - lo).astype(np.int32))
                    hit_hash.append(signed(h[found[part]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(begins, pa.int32()),
                 list_array(kept, pa.int64()), list_array(hit_pos, pa.int32()), list_array(hit_hash, pa.int64())],
                names=["doc_id", "begin", "words", "pos", "h"])

    found = scratch.save(
        rows.mapInArrow(regions, f"doc_id {kind}, begin int, words array<long>, pos array<int>, h array<long>")
        .withColumn("region", F.monotonically_increasing_id()), "regions")
    hits = found.select("region", F.explode(F.arrays_zip("pos", "h")).alias("s")).select(
        "region", F.col("s.pos").alias("pos"), F.col("s.h").alias("h"))
    diagonals = scratch.save(
        hits.join(bench_seeds, "h").select("region", "c", (F.col("pos") - F.col("ipos")).alias("diagonal"))
        .distinct(), "diagonals")

    def compare(batches):
        for batch in batches:
            keep, spots = [], []
            doc_words, item_words = batch.column("words"), batch.column("item_words")
            for i, d in enumerate(batch.column("diagonal").to_pylist()):
                a, b = doc_words[i].values.to_numpy(), item_words[i].values.to_numpy()
                lo, hi = max(0, d), min(len(a), len(b) + d)
                if run := overlap(a[lo:hi] == b[lo - d:hi - d], len(b), min_words):
                    start, end, equal = run
                    keep.append(i)
                    spots.append((lo + start, lo + start - d, end - start, equal))
            take = pa.array(keep, pa.int64())
            at = np.array(spots, dtype=np.int32).reshape(-1, 4)
            begin = batch.column("begin").take(take).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("c").take(take),
                 pa.array((begin + at[:, 0]).astype(np.int32)), *(pa.array(at[:, j].copy()) for j in (1, 2, 3))],
                names=["doc_id", "c", "doc_start", "item_start", "n_words", "n_equal"])

    verified = (diagonals.join(found.select("region", "doc_id", "begin", "words"), "region")
                .join(distinct.withColumnRenamed("words", "item_words"), "c")
                .mapInArrow(compare, f"doc_id {kind}, c long, doc_start int, item_start int, n_words int, n_equal int"))
    best = verified.groupBy("doc_id", "c").agg(
        F.max(F.struct("n_equal", "n_words", (-F.col("doc_start")).alias("doc_start"),
                       (-F.col("item_start")).alias("item_start"))).alias("s"))
    return best.join(items, "c").select(
        "doc_id", "item_id", (-F.col("s.doc_start")).alias("doc_start"), (-F.col("s.item_start")).alias("item_start"),
        F.col("s.n_words").alias("n_words"), F.col("s.n_equal").alias("n_equal")).distinct()


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """The documents, same columns, without those that overlap with an item.

    A contaminated row with a null id takes out all rows with a null id.
    """
    bad = find_overlaps(docs, benchmark, key=key, **options).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad["bad_id"]), "left_anti")
