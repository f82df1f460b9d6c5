r"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds the hashes of its distinct five-word shingles (words are
``[^\x20\x09-\x0D]+`` of the text with A-Z lower-cased; fewer than five words are
one shingle of their own, no word gives the empty set, which links with nothing).
Two documents link when their Jaccard similarity is at least 0.85, compared in
integers on the full sets.  Equal sets are one *node*.

Classic banding with L tables of 2 * ROWS minima each computes 2 * ROWS * L minima.
Here two small collections of ``HALVES`` half keys, each of ``ROWS`` minima, are
made, and the tables are all their pairs: table (i, j) is keyed by half key i of the
first and j of the second collection.  So HALVES**2 = 100 tables of 6 minima cost 60
minima a document, not 600.  A pair shares a table if it shares some half key of
either collection:

    P(s) = (1 - (1 - s**ROWS) ** HALVES) ** 2

which is 0.99985 at 0.85, 0.99999 at 0.9 and 0.0001 at 0.1.

Only half keys that several nodes have can make a shared table, so nodes without
such keys on both sides never enter the tables.  Candidates come from
``clusters.link_components``: every node of a table is verified against a pivot,
rounds of pivots follow, and what they leave undecided is paired at the first half
key that a pair shares, behind bounds by size and by sketch.  No table's pairs are
all made, and no shared table is left untested.

Hashes of shingles and sets are 64-bit: taking two different ones for equal has a
probability of about 2**-64 a pair.

Edge cases: null, empty and blank texts have the empty set (0 shingles) and are
their own component; a null id is never a component's id unless all its ids are
null; rows that repeat an id are rows of their own (equal texts: one component);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clusters
from .common import Scratch, fixed_bitmap, in_bitmap, in_slices, list_array
from .hashing import MULTIPLIERS, WordHashes, mix, shingles, signed

WIDTH = 5
SIMILARITY = (17, 20)            # 0.85
HALVES, ROWS = 10, 3             # half keys of a collection, minima of a half key
SKETCH = 2048                    # bits
_SCREEN = (20, 28)               # log2 of the bits of the candidates' bitmap: 0.1 to 32 MB
_FACTORS = (mix(np.arange(1, 2 * HALVES * ROWS + 1, dtype=np.uint64) * MULTIPLIERS[0]) >> np.uint64(32)
            ).astype(np.uint32) | np.uint32(1)
_TAGS = mix(np.arange(1, 2 * HALVES + 1, dtype=np.uint64) * MULTIPLIERS[1])


def text_set(words: WordHashes, text: str) -> np.ndarray:
    return shingles(words.of(text.encode("utf-8", "replace").lower().split()), WIDTH)


def set_hash(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def half_keys(s: np.ndarray) -> np.ndarray:
    """int64[2 * HALVES] of a set that is not empty: the first collection's half
    keys, then the second's.  A key tells its place, so that keys of different
    places differ."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    minima = np.full(len(_FACTORS), np.uint32(0xFFFFFFFF))
    for at in range(0, len(low), 4096):
        np.minimum(minima, (low[None, at:at + 4096] * _FACTORS[:, None]).min(axis=1), out=minima)
    parts = minima.astype(np.uint64).reshape(2 * HALVES, ROWS) * MULTIPLIERS[2:2 + ROWS]
    return signed(mix(parts.sum(axis=1, dtype=np.uint64) + _TAGS))


def sketch(s: np.ndarray) -> np.ndarray:
    """int64[SKETCH // 64], a bit for each shingle's cell: a bit that only one of
    two sketches has stands for a shingle that only one of the sets holds."""
    cells = s >> np.uint64(65 - SKETCH.bit_length())
    words = np.zeros(SKETCH // 64, dtype=np.uint64)
    np.bitwise_or.at(words, cells >> np.uint64(6), np.uint64(1) << (cells & np.uint64(63)))
    return signed(words)


def _signatures(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, t, node (null for the empty set), n, its half keys."""
    def run(batches):
        words = WordHashes()
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for texts in in_slices(batch):
                for text in texts:
                    s = text_set(words, text)
                    nodes.append(set_hash(s) if len(s) else None)
                    sizes.append(len(s))
                    keys.append(half_keys(s) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                 list_array(keys, pa.int64())], names=["doc_id", "t", "node", "n", "halves"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, t long, node long, n long, halves array<long>")


def _shared_halves(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """(node, us, vs): the half keys of either collection that other nodes have as
    well, of the nodes that have some of both."""
    rows = nodes.select("node", F.posexplode("halves").alias("at", "half"))
    several = rows.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    several = scratch.save(several, "several")
    kept = rows.join(several, "half", "left_semi").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("at", "half"))).alias("kept"))
    side = lambda test: F.transform(F.filter("kept", test), lambda x: x["half"])
    return scratch.save(kept.select("node", side(lambda x: x["at"] < HALVES).alias("us"),
                                    side(lambda x: x["at"] >= HALVES).alias("vs"))
                        .where("size(us) > 0 and size(vs) > 0"), "halves")


def _screen(hashes: DataFrame, column: str, rows: int) -> np.ndarray:
    """A bitmap whose size follows the number of hashes (32 MB at most)."""
    least, most = _SCREEN
    return fixed_bitmap(hashes, column, min(most, max(least, (16 * rows).bit_length())))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles, component_id (the smallest key
    reachable), kept (whether the document has that key)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"),
                       F.xxhash64(F.col(text).cast("string")).alias("t"))
    sets = scratch.save(_signatures(docs), "sets")
    nodes = scratch.save(sets.where("node is not null").groupBy("node").agg(
        F.min("t").alias("t"), F.first("n").alias("n"), F.first("halves").alias("halves"),
        F.min("doc_id").alias("least"), F.count("*").alias("copies")), "nodes")
    halves = _shared_halves(scratch, nodes)
    tables = halves.select("node", F.explode("us").alias("u"), "vs").select(
        "node", "u", F.explode("vs").alias("v")).select(
        F.xxhash64("u", "v").alias("key"), "node", F.lit(True).alias("short"))
    full: dict[str, DataFrame] = {}

    def prepare(met: DataFrame) -> None:
        """The full sets of the nodes that share a table, from one of their texts."""
        wanted = scratch.save(nodes.join(met.distinct(), "node", "left_semi").select("t", "node"), "wanted")
        bits = spark.sparkContext.broadcast(_screen(wanted, "t", wanted.count()))

        def run(batches):
            words, done = WordHashes(), set()
            for batch in batches:
                t = batch.column("t").to_numpy()
                rows = [i for i in np.flatnonzero(in_bitmap(bits.value, t.view(np.uint64))) if t[i] not in done]
                done.update(t[rows])                              # copies within a task once
                chosen = batch.take(pa.array(rows, pa.int64()))
                found, members, marks = [], [], []
                for texts in in_slices(chosen):
                    for each in texts:
                        s = text_set(words, each)
                        if len(s):
                            found.append(set_hash(s))
                            members.append(signed(s))
                            marks.append(sketch(s))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.int64()), list_array(members, pa.int64()), list_array(marks, pa.int64())],
                    names=["node", "members", "sketch"])

        full["sets"] = scratch.save(
            docs.select("text", "t").mapInArrow(run, "node long, members array<long>, sketch array<long>")
            .groupBy("node").agg(F.first("members").alias("members"), F.first("sketch").alias("sketch")), "full")

    num, den = SIMILARITY

    def verify(pairs: DataFrame) -> DataFrame:
        a = full["sets"].select(F.col("node").alias("a"), F.col("members").alias("ma"))
        b = full["sets"].select(F.col("node").alias("b"), F.col("members").alias("mb"))
        both, na, nb = F.size(F.array_intersect("ma", "mb")), F.size("ma"), F.size("mb")
        return (pairs.join(a, "a").join(b, "b").where(den * F.least(na, nb) >= num * F.greatest(na, nb))
                .where((num + den) * both >= num * (na + nb)).select("a", "b"))

    def pairs_left(rest: DataFrame) -> DataFrame:
        """Pairs of different labels that share a table and that size and sketch
        leave, each at its first shared half key of the first collection."""
        rows = (rest.select("node", "label").distinct().join(halves, "node")
                .join(full["sets"].select("node", F.size("members").cast("long").alias("n"), "sketch"), "node"))
        rows = rows.withColumn("u", F.explode("us"))
        other = rows.select("u", *(F.col(c).alias(f"{c}2") for c in rows.columns if c != "u"))
        return rows.join(other, "u").where(f"""
            node < node2 and label <> label2 and {den} * least(n, n2) >= {num} * greatest(n, n2)
            and u = array_intersect(us, us2)[0] and arrays_overlap(vs, vs2)
            and {num + den} * aggregate(zip_with(sketch, sketch2, (x, y) -> bit_count(x ^ y)), 0, (s, d) -> s + d)
                <= {den - num} * (n + n2)""").select(F.col("node").alias("a"), F.col("node2").alias("b"))

    linked = clusters.link_components(scratch, tables, verify, prepare, pairs_left=pairs_left)
    # a node's smallest id, then its component's; only nodes with a link need the join
    ids = nodes.select("node", "least").join(linked, "node")
    least = ids.groupBy("comp").agg(F.min("least").alias("component_id"))
    found = ids.select("node", "comp").join(least, "comp").select("node", "component_id")
    alone = nodes.join(linked, "node", "left_anti").where("copies > 1").select(
        "node", F.col("least").alias("component_id"))
    places = scratch.save(found.union(alone).withColumnRenamed("node", "node_"), "components")
    # written, so that a node with many copies is a plain join's side, which AQE splits; empty sets by their row
    own = F.coalesce("node", F.xxhash64("doc_id", F.lit("empty")))
    rows = sets.select("doc_id", "n", "node", own.alias("own"))
    joined = rows.join(places, rows["own"] == places["node_"], "left")
    component = F.when(F.col("node").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.col("doc_id").eqNullSafe(component).alias("kept"))
