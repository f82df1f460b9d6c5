r"""N-gram Jaccard self-join by a size-aware heavy-light join.

A document's set holds the hashes of its distinct five-word shingles (words are
``[^\x20\x09-\x0D]+`` of the text with A-Z lower-cased; fewer than five words
count as one shingle, no word gives the empty set, which links with nothing).
Two documents link when their Jaccard similarity is at least 0.8, compared in
integers.  Equal sets are one *node*, so that copies are never paired.

* **Light** sets, of at most ``x`` shingles, are found by fixed-size subsets: for
  every partner size the overlap needed, c, is known, and both sides emit the
  hashes of all their c-subsets, of which linked sets share one.
* **Heavy** sets are found by inverted lists of shingles.  Lists are scanned only
  for the rarest shingles of a set: as an overlap of 80 % leaves at most a fifth
  of either set out, linked sets share one of their first ``n - ceil(0.8 n) + 1``
  in any common order.  The order puts the shingles that no other document has
  first (they need no list, and a set with more than a fifth of them links with
  nothing), those of long lists last.

The boundary ``x`` is chosen by cost: subsets emitted against lists scanned, from
the measured number of sets of each size.  Light sets close enough to the
boundary to link with a heavy one are entered in the lists as well.

Which shingles occur twice, and which have long lists, is counted over all
documents and kept as fixed bitmaps (``repeats``).  A chance hit there changes the
order for all documents alike, so nothing is lost.  Pairs come from
``clusters.link_components``, which never makes all pairs of a list, and are
verified on the full sets.

Hashes are 64-bit: two different shingles of a pair of documents, or two
different sets, are taken for equal with a probability of about 2**-64 each.

Edge cases: null or empty texts have ``n_shingles`` 0 and are their own
component; rows with a null id take part, a component's id is its smallest
non-null id; repeated rows link as copies do (rows with empty texts do not);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import chain, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clusters
from .common import Scratch, fixed_bitmap, in_bitmap, in_slices, list_array
from .hashing import MULTIPLIERS, WordHashes, mix, shingles, signed, tag
from .repeats import repeat_bitmaps

WIDTH = 5
LONG_LISTS = (64, 512, 4096)     # a list of so many documents is long; the first that marks few enough
BITS_LOG2 = 27                   # of the bitmaps of shingles: 16 MB each
LARGEST_LIGHT = 12               # the boundary is sought up to here
_MAX_LONG = 1 << 23              # marked long lists: a sixteenth of the bitmap


def needed_overlap(n: int, m: int) -> int:
    """Least overlap of linked sets: 100 o >= 80 (n + m - o)."""
    return -(-4 * (n + m) // 9)


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1 if n else 0


def subset_sizes(n: int, boundary: int) -> list[int]:
    """The overlaps needed between a light set of n and any light partner."""
    partners = [m for m in range(1, boundary + 1) if 5 * m >= 4 * n and 5 * n >= 4 * m]
    return sorted({c for m in partners if (c := needed_overlap(n, m)) <= min(n, m)})


def subset_count(n: int, boundary: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n, boundary))


def choose_boundary(sizes: dict[int, tuple[int, int]]) -> int:
    """Cheapest boundary; sizes: n -> (sets, entries they make in long lists).

    A heavy set pays for its prefix and for scanning its lists (a long one
    counts as LONG_LISTS[0] rows); a light set pays for its subsets, and for its
    prefix too if it can link with a heavy set.
    """
    def cost(x):
        total = 0
        for n, (sets, long_entries) in sizes.items():
            lists = sets * prefix_length(n) + LONG_LISTS[0] * long_entries
            if n > x:
                total += lists
            else:
                total += sets * subset_count(n, x) + (lists if 5 * n >= 4 * (x + 1) else 0)
        return total
    return min(range(LARGEST_LIGHT + 1), key=cost)


def text_set(words: WordHashes, text: str) -> np.ndarray:
    return shingles(words.of(text.encode("utf-8", "replace").lower().split()), WIDTH)


def _node(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _order_bitmaps(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the shingles of at least two documents, and of long lists."""
    words = WordHashes()

    def sets(batch):
        for texts in in_slices(batch):
            for t in texts:
                yield text_set(words, t)

    found = repeat_bitmaps(docs.select("text"), sets, (2, *LONG_LISTS), BITS_LOG2)
    long = next((k for k in LONG_LISTS if found[k][1] <= _MAX_LONG), LONG_LISTS[-1])
    return found[2][0], found[long][0]


def _signatures(docs: DataFrame, bitmaps: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per document: node, n, s (shingles that occur elsewhere), short, entries in
    long lists, the prefix's shingles of these (none if too few), all of a small set.

    A set links with no smaller number of shingles than 8/9 of its own only if
    the first ``short`` ones hold a common one; with a smaller set, the prefix.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps)     # 2 x 16 MB
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        words, (repeated, long) = WordHashes(), shared.value
        for batch in batches:
            at = 0
            for texts in in_slices(batch):                   # written slice by slice: only one is held
                nodes, sizes, elsewhere_n, short, long_entries, prefixes, small = [], [], [], [], [], [], []
                for text in texts:
                    s = text_set(words, text)
                    n, p = len(s), prefix_length(len(s))
                    elsewhere = s[in_bitmap(repeated, s)] if n else s
                    hot = in_bitmap(long, elsewhere)
                    # rarest first: those of this set alone, then short lists, then long ones
                    order = np.concatenate((elsewhere[~hot], elsewhere[hot]))
                    order = order[:max(0, p - (n - len(elsewhere)))] if 5 * len(elsewhere) >= 4 * n else s[:0]
                    elsewhere_n.append(len(elsewhere))
                    short.append(max(0, len(elsewhere) + 1 + (-8 * n // 9)))
                    nodes.append(_node(s) if n else None)
                    sizes.append(n)
                    long_entries.append(max(0, len(order) - int((~hot).sum())))
                    prefixes.append(signed(order))
                    small.append(signed(s) if n <= LARGEST_LIGHT else signed(s[:0]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array(elsewhere_n, pa.int64()), pa.array(short, pa.int64()),
                     pa.array(long_entries, pa.int64()), list_array(prefixes, pa.int64()),
                     list_array(small, pa.int64())],
                    names=["doc_id", "node", "n", "s", "short", "long_entries", "prefix", "small"])
                at += len(texts)

    return docs.mapInArrow(run, f"doc_id {kind}, node long, n long, s long, short long, long_entries long, "
                                "prefix array<long>, small array<long>")


def _light_buckets(sets: DataFrame, boundary: int) -> DataFrame:
    """(key, node): the hashed c-subsets of the light sets, for each c needed."""
    def run(batches):
        for batch in batches:
            keys, nodes = [], []
            for node, s in zip(batch.column("node").to_pylist(), batch.column("small").to_pylist()):
                own = mix(np.array(s, dtype=np.int64).view(np.uint64) * MULTIPLIERS[40])
                for c in subset_sizes(len(s), boundary):
                    picks = np.array(list(combinations(range(len(s)), c)))
                    made = mix(own[picks].sum(axis=1, dtype=np.uint64) + tag(c, 41))
                    keys.append(signed(made))
                    nodes.append(np.full(len(made), node))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)),
                 pa.array(np.concatenate(nodes) if nodes else np.empty(0, np.int64))], names=["key", "node"])

    return sets.where((F.col("n") > 0) & (F.col("n") <= boundary)).select("node", "small").mapInArrow(
        run, "key long, node long").withColumn("short", F.lit(True))


def ngram_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    sets = scratch.save(_signatures(docs, _order_bitmaps(docs)), "sets")
    sizes = {r["n"]: (r["sets"], r["long"]) for r in
             sets.where((F.col("n") > 0) & (F.col("n") <= LARGEST_LIGHT)).groupBy("n")
             .agg(F.count("*").alias("sets"), F.sum("long_entries").alias("long")).collect()}
    boundary = choose_boundary(sizes)                              # at most LARGEST_LIGHT rows
    lists = sets.where(5 * F.col("n") >= 4 * (boundary + 1)).select(
        F.posexplode("prefix").alias("at", "key"), "node", "short").select("key", "node", (F.col("at") < F.col("short")).alias("short"))
    buckets = lists.union(_light_buckets(sets, boundary))
    full: dict[str, DataFrame] = {}

    def prepare(nodes: DataFrame) -> None:
        """The full sets of the nodes that share a bucket, made anew from the texts."""
        wanted = spark.sparkContext.broadcast(fixed_bitmap(nodes, "node"))

        def run(batches):
            words, bits, met = WordHashes(), wanted.value, set()
            for texts in chain.from_iterable(map(in_slices, batches)):
                found, members = [], []
                for t in texts:
                    s = text_set(words, t)
                    node = _node(s)
                    if len(s) and node not in met and in_bitmap(bits, np.array([node]).view(np.uint64))[0]:
                        met.add(node)                            # copies within a task once
                        found.append(node)
                        members.append(signed(s))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), list_array(members, pa.int64())],
                                                 names=["node", "members"])

        full["sets"] = scratch.save(
            docs.select("text").mapInArrow(run, "node long, members array<long>")
            .groupBy("node").agg(F.first("members").alias("members")), "full")

    def verify(pairs: DataFrame) -> DataFrame:
        a = full["sets"].select(F.col("node").alias("a"), F.col("members").alias("ma"))
        b = full["sets"].select(F.col("node").alias("b"), F.col("members").alias("mb"))
        both = F.size(F.array_intersect("ma", "mb"))
        return (pairs.join(a, "a").join(b, "b")
                .where((5 * F.size("ma") >= 4 * F.size("mb")) & (5 * F.size("mb") >= 4 * F.size("ma")))
                .where(180 * both >= 80 * (F.size("ma") + F.size("mb"))).select("a", "b"))

    def limits(nodes: DataFrame) -> DataFrame:
        """Light sets may share subsets instead of list entries: no bound on their rest."""
        known = sets.join(nodes, "node").groupBy("node").agg(
            F.first("n").alias("n"), F.first("s").alias("s"), F.first(F.size("prefix")).alias("p"))
        rest = F.when(F.col("n") <= boundary, F.col("s")).otherwise(F.col("s") - F.col("p"))
        return known.select("node", "n", "s", rest.alias("rest"))

    linked = clusters.link_components(scratch, buckets, verify, prepare, limits, limits_known=True)
    # the smallest id of each node, then of its component; only nodes with copies or links are joined
    nodes = scratch.save(sets.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("copies")), "nodes")
    ids = nodes.join(linked, "node").select("node", "least", "comp")
    smallest = ids.groupBy("comp").agg(F.min("least").alias("component_id"))
    places = ids.join(smallest, "comp").select("node", "component_id").union(
        nodes.join(linked, "node", "left_anti").where("copies > 1").select("node", "least"))
    # written, so that AQE splits the join where a node has many copies; empty sets lie by their row
    places = scratch.save(places.withColumnRenamed("node", "place"), "places")
    own = F.coalesce("node", F.xxhash64("doc_id", F.lit("empty")))
    joined = sets.select("doc_id", "n", "node", own.alias("own")).join(places, F.col("own") == F.col("place"), "left")
    component = F.when(F.col("node").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
