"""Fuzzy line de-duplication by MinHash.

Lines are normalised (lower case, single blanks, trimmed); those of at least
``min_chars`` characters take part, shorter ones stay where they are.  Equal
normalised lines are one node.  A node's signature holds the minima of 161 hash
functions over its character n-grams (``gram`` characters each); 23 bands of 7
minima are the buckets (a pair of Jaccard similarity 0.8 shares one with a
probability of 0.9956, of 0.85 with 0.9998).  ``clusters.link_components`` takes
pairs from the buckets, the exact Jaccard similarity of the distinct n-grams (at
least 0.8) decides, and the linked nodes' components keep one line each: the
first by id, then by line number.

What 0.8 means depends on ``gram``: n replaced characters in the middle of a line
of L cost n + gram - 1 of its L - gram + 1 n-grams.  With ``GRAM``, the default, one
replaced character is linked from 49 characters up, a word of six letters from 94;
with 10-grams from 99 and 144.  Nearer to an end it costs less.

Lines are addressed by (id, hash of the text, line number).

Edge cases: a null text stays null, an empty one empty; rows with a null id take
part and come first; rows that repeat both id and text get the same result; an
empty table gives an empty result; all other columns pass through unchanged,
whatever their names.  Nodes and n-grams are compared by 64-bit hashes: two
different ones are taken for equal with a probability of about 2**-64.
"""

from __future__ import annotations

import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clusters
from .common import Scratch, fixed_bitmap, in_bitmap, in_slices
from .hashing import MULTIPLIERS, mix, signed, tag
from .repeats import repeat_bitmaps

MIN_CHARS = 20
GRAM = SHORT_GRAM = 5
BANDS, ROWS = 23, 7              # 7: unrelated lines share some 5-grams, with 6 ten times as many would meet
MAX_BROADCAST = (250_000, 2_000_000)   # documents, lines to remove: under 30 MB; beyond, a shuffle join
SIMILARITY = 0.8
SKETCH = 4096                    # bits that stand for a line's set unless told otherwise: several for each n-gram
SENT = 1024                      # bits of those that joins of pairs carry: more than most sets' n-grams
KEPT = 5                         # bytes written of a band's key: with the band's number, 2**-40 for two to clash
_BLOCK = 1 << 16                 # characters hashed together: stays in the cache
_SIGNED = 1 << 16                # characters signed together: two blocks of hashes stay in the cache
_ROWS = 1024                     # rows written or compared together

_A = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * MULTIPLIERS[61]).astype(np.uint32) | np.uint32(1)
_G = [(m >> np.uint64(32)).astype(np.uint32) | np.uint32(1) for m in MULTIPLIERS[50:55]]


#: White space other than a blank and the line end, and runs of blanks.
_UNEVEN = tuple(chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (10, 32)) + ("  ",)


#: A character that no line of blanks has.
_NOT_BLANK = "[^" + "".join(f"\\x{{{ord(x):x}}}" for x in (*_UNEVEN[:-1], "\n", " ")) + "]"


def normalise(line: str) -> str:
    return " ".join(line.lower().split())


def _grams(c: np.ndarray, gram: int, factors: list) -> np.ndarray:
    """Hashes of the n-grams of a code point array, by doubling; not mixed yet."""
    h, size, i = c, 1, 0
    while 2 * size <= gram:
        h, size, i = h[:-size] * factors[i] + h[size:], 2 * size, i + 1
    return h if size == gram else (h[:size - gram] * factors[i]) ^ h[gram - size:]


def gram_sets(lines: list[str], gram: int = GRAM) -> list[np.ndarray]:
    """Distinct 64-bit hashes of each line's n-grams, ascending."""
    c = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    grams = mix(_grams(c, gram, MULTIPLIERS[50:]))
    sets, begin = [], 0
    for line in lines:
        g = np.sort(grams[begin:begin + len(line) - gram + 1])
        sets.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
        begin += len(line)
    return sets


def gram_set(line: str, gram: int = GRAM) -> np.ndarray:
    return gram_sets([line], gram)[0]


def gram_hashes(c: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """uint32 hashes of the n-grams of a code point array."""
    h = _grams(c, gram, _G)
    h ^= h >> np.uint32(15)
    h *= _G[4]
    h ^= h >> np.uint32(13)
    return h


def band_keys(lines: list[str], gram: int = GRAM) -> np.ndarray:
    """int64[line, band] of normalised lines of at least ``gram`` characters."""
    out = np.empty((len(lines), BANDS), dtype=np.int64)
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (size == 0 or size + len(lines[end]) <= _SIGNED):
            size += len(lines[end])
            end += 1
        out[at:end] = _block_keys(lines[at:end], gram)
        at = end
    return out


def _block_keys(lines: list[str], gram: int) -> np.ndarray:
    lengths = np.array([len(x) for x in lines])
    c = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), dtype=np.uint32)
    grams, ends = gram_hashes(c, gram), np.cumsum(lengths)
    within = np.ones(len(c), dtype=bool)                     # not across the end of a line
    for i in range(1, gram):
        within[ends - i] = False
    grams = grams[within[:len(grams)]]
    counts = lengths - gram + 1
    begin = np.cumsum(counts) - counts
    minima = np.empty((BANDS * ROWS, len(lines)), dtype=np.uint32)
    hashed = np.empty_like(grams)
    for i, a in enumerate(_A):
        np.multiply(grams, a, out=hashed)
        np.minimum.reduceat(hashed, begin, out=minima[i])
    keys = np.empty((len(lines), BANDS), dtype=np.int64)
    for b in range(BANDS):
        h = np.full(len(lines), tag(b, 60))
        for r in range(ROWS):
            h += minima[b * ROWS + r] * MULTIPLIERS[r]
        keys[:, b] = signed(mix(h))
    return keys


def sketches(grams: np.ndarray, sizes: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """int64[set, bits // 64] of sets of ``sizes`` n-grams, one after the other: a
    bit for each n-gram's cell.  A bit that only one of two sketches has set stands
    for an n-gram that only one of the sets holds."""
    cells = grams >> np.uint64(65 - bits.bit_length())
    words = np.zeros(len(sizes) * (bits // 64), dtype=np.uint64)
    at = np.repeat(np.arange(len(sizes)) * (bits // 64), sizes) + (cells >> np.uint64(6)).astype(np.int64)
    np.bitwise_or.at(words, at, np.uint64(1) << (cells & np.uint64(63)))
    return signed(words).reshape(len(sizes), bits // 64)


def sketch(grams: np.ndarray) -> np.ndarray:
    """:func:`sketches` of one set."""
    return sketches(grams, np.array([len(grams)]))[0]


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of n-grams have a Jaccard similarity of at least SIMILARITY."""
    least = SIMILARITY * (len(x) + len(y)) / (1 + SIMILARITY)        # of their overlap
    if min(len(x), len(y)) < least - 1e-9:
        return False
    both = np.sort(np.concatenate((x, y)), kind="stable")
    return int((both[1:] == both[:-1]).sum()) >= least - 1e-9


def linked(a: list[str], b: list[str], gram: int = GRAM) -> list[bool]:
    """Which lines of ``a`` are similar to the line of ``b`` at the same place."""
    out: list[bool] = []
    while len(out) < len(a):
        places: dict[str, int] = {}                          # a block's lines, each taken apart once
        begin = end = len(out)
        size = 0
        while end < len(a) and (size == 0 or size + len(a[end]) + len(b[end]) <= 4 * _BLOCK):
            for line in (a[end], b[end]):
                if line not in places:
                    places[line] = len(places)
                    size += len(line)
            end += 1
        sets = gram_sets(list(places), gram)
        out += [similar(sets[places[x]], sets[places[y]]) for x, y in zip(a[begin:end], b[begin:end])]
    return out


def packed(values: np.ndarray, lengths: list[int] | np.ndarray) -> pa.BinaryArray:
    """The rows of an array as binary values, ``lengths`` rows in each."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(np.asarray(lengths, dtype=np.int64) * (values.itemsize * values[:1].size), out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths),
                                 [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(the values of packed rows, one after the other; the bytes in each row)"""
    if not len(column):
        return np.empty(0, kind), np.empty(0, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data or b"", dtype=np.uint8)[at[0]:at[-1]].view(kind), np.diff(at)


def kept_bytes(keys: np.ndarray) -> np.ndarray:
    """uint8[line, BANDS * KEPT] of :func:`band_keys`: the upper KEPT bytes of each key."""
    high = keys.view(np.uint64) >> np.uint64(64 - 8 * KEPT)
    rows = np.empty((len(keys), BANDS * KEPT), dtype=np.uint8)
    rows[:, :4 * BANDS] = (high >> np.uint64(8)).astype("<u4").view(np.uint8)
    rows[:, 4 * BANDS:] = high.astype(np.uint8)
    return rows


def kept_keys(rows: np.ndarray) -> np.ndarray:
    """uint64[line, BANDS]: the bytes that were kept, then zeros and the band's number."""
    keys = np.ascontiguousarray(rows[:, :4 * BANDS]).view("<u4").astype(np.uint64) << np.uint64(32)
    keys |= rows[:, 4 * BANDS:].astype(np.uint64) << np.uint64(24)
    return keys | np.arange(BANDS, dtype=np.uint64)


def _node(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace")) - (1 << 63)


def _eligible(text: str, min_chars: int) -> list[tuple[int, str]]:
    """(line number, normalised line) of the lines that take part."""
    if any(x in text for x in _UNEVEN):
        lines = map(normalise, text.split("\n"))
    else:                                                    # the same, as only the ends need care
        lines = (x.strip(" ") for x in text.lower().split("\n"))
    return [(i, n) for i, n in enumerate(lines) if len(n) >= min_chars]


def line_drops(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
               min_chars: int = MIN_CHARS, gram: int = GRAM) -> DataFrame:
    """(k, h, drops): id, hash of the text, numbers of the lines to remove."""
    if not 2 <= gram <= min(min_chars, 16):
        raise ValueError(f"gram must be from 2 to 16 and at most min_chars ({min_chars})")
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["k"]

    def signatures(batches):
        for batch in batches:
            i = 0
            for texts in in_slices(batch):                   # written slice by slice: only one is held
                row, sizes, pos, nodes, lines = [], [], [], [], []
                for t in texts:
                    found = _eligible(t, min_chars)
                    for at in range(0, len(found), _ROWS):   # a document's lines are one row, or some
                        row.append(i)
                        sizes.append(len(found[at:at + _ROWS]))
                    for p, n in found:
                        pos.append(p)
                        nodes.append(_node(n))
                        lines.append(n)
                    i += 1
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k").take(take), batch.column("h").take(take),
                     packed(np.array(pos, dtype=np.int32), sizes), packed(np.array(nodes, dtype=np.int64), sizes),
                     packed(kept_bytes(band_keys(lines, gram)), sizes)],
                    names=["k", "h", "pos", "nodes", "bands"])

    lines = scratch.save(rows.mapInArrow(
        signatures, f"k {kind}, h long, pos binary, nodes binary, bands binary"), "lines")

    def nodes_of(batch):
        return unpacked(batch.column("nodes"), np.uint64)[0]

    def bands_of(batch):
        return unpacked(batch.column("bands"), np.uint8)[0].reshape(-1, BANDS * KEPT)

    def node_hashes(batch):
        yield nodes_of(batch)

    again = spark.sparkContext.broadcast(                             # 8 MB: nodes met twice
        repeat_bitmaps(lines.select("nodes"), node_hashes, (2,))[2][0])

    def equal_lines(batches):
        for batch in batches:
            nodes, first = np.unique(nodes_of(batch), return_index=True)
            met = in_bitmap(again.value, nodes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(nodes[met])), packed(bands_of(batch)[first[met]], np.ones(met.sum(), np.int64))],
                names=["node", "bands"])

    def in_rows(batches):
        for batch in batches:
            nodes, bands = batch.column("node").to_numpy(), unpacked(batch.column("bands"), np.uint8)[0]
            sizes = [len(nodes[at:at + _ROWS]) for at in range(0, len(nodes), _ROWS)]
            yield pa.RecordBatch.from_arrays(
                [packed(nodes, sizes), packed(bands.reshape(-1, BANDS * KEPT), sizes)], names=["nodes", "bands"])

    # equal lines are one node, whose bands count once
    signed_nodes = lines.select("nodes", "bands")
    merged = scratch.save(signed_nodes.mapInArrow(equal_lines, "node long, bands binary")
                          .repartition("node").groupBy("node").agg(F.first("bands").alias("bands"))
                          .mapInArrow(in_rows, signed_nodes.schema), "merged")
    nodes = (signed_nodes.withColumn("merged", F.lit(False))
             .union(merged.withColumn("merged", F.lit(True))))

    def each_once(batch):
        """The nodes and their keys, those met twice from the merged rows only, some rows at a time."""
        for at in range(0, batch.num_rows, _ROWS):
            some = batch.slice(at, _ROWS)
            nodes, sizes = unpacked(some.column("nodes"), np.uint64)
            once = np.repeat(some.column("merged").to_numpy(zero_copy_only=False), sizes // 8) | ~in_bitmap(again.value, nodes)
            yield nodes[once], kept_keys(bands_of(some)[once]).ravel()

    def band_hashes(batch):
        for _, keys in each_once(batch):
            yield keys

    repeated = spark.sparkContext.broadcast(                          # 8 MB: bands of several nodes
        repeat_bitmaps(nodes, band_hashes, (2,))[2][0])

    def screened(batches):
        for nodes, keys in chain.from_iterable(map(each_once, batches)):
            at = np.flatnonzero(in_bitmap(repeated.value, keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(keys[at])), pa.array(signed(nodes[at // BANDS]))], names=["key", "node"])

    # a band of one node alone needs no bucket
    buckets = scratch.save(nodes.mapInArrow(screened, "key long, node long"), "buckets").withColumn(
        "short", F.lit(True))
    candidates: dict[str, DataFrame] = {}

    def of_nodes(nodes: DataFrame) -> DataFrame:
        """The candidates among ``nodes``, and some more by chance: nothing is shuffled."""
        wanted = spark.sparkContext.broadcast(fixed_bitmap(nodes, "node"))

        def run(batches):
            for batch in batches:
                nodes = batch.column("node").to_numpy().view(np.uint64)
                yield batch.filter(pa.array(in_bitmap(wanted.value, nodes)))

        return candidates["lines"].mapInArrow(run, candidates["lines"].schema)

    def prepare(nodes: DataFrame) -> None:
        """The normalised lines of the nodes that share a bucket."""
        wanted = spark.sparkContext.broadcast(fixed_bitmap(nodes, "node"))

        def run(batches):
            bits = wanted.value
            for texts in chain.from_iterable(map(in_slices, batches)):
                found: dict[int, str] = {}
                for t in texts:
                    found.update((_node(n), n) for _, n in _eligible(t, min_chars))
                nodes = np.fromiter(found, dtype=np.int64, count=len(found))
                keep = in_bitmap(bits, nodes.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[keep]), pa.array([found[n] for n in nodes[keep].tolist()], pa.string())],
                    names=["node", "line"])

        candidates["lines"] = scratch.save(
            rows.select("text").mapInArrow(run, "node long, line string")
            .repartition("node").groupBy("node").agg(F.first("line").alias("line")), "candidates")
        candidates["first"] = candidates["lines"]

    def verify(pairs: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                keep = linked(batch.column("la").to_pylist(), batch.column("lb").to_pylist(), gram)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n).filter(pa.array(keep, pa.bool_())) for n in ("a", "b")], names=["a", "b"])

        # the first pairs, with pivots, hold all candidates, later ones few
        lines = candidates.pop("first", None) or of_nodes(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        a = lines.select(F.col("node").alias("a"), F.col("line").alias("la"))
        b = lines.select(F.col("node").alias("b"), F.col("line").alias("lb"))
        return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a long, b long")

    def limits(nodes: DataFrame) -> DataFrame:
        """Sizes of the lines' sets, how many of their n-grams several of these
        lines hold (bands say nothing about the rest), and their sketches.  Lines
        that the bitmap lets through by chance may only raise the second."""
        chosen = scratch.save(of_nodes(nodes), "limited")

        def blocks_of(batch):
            """(block of the batch's rows, their sets one after the other, the sets' sizes)"""
            for at in range(0, batch.num_rows, _ROWS):
                block = batch.slice(at, _ROWS)
                sets = gram_sets(block.column("line").to_pylist(), gram)
                yield block, np.concatenate(sets), np.array([len(x) for x in sets])

        def hashes_of(batch):
            for _, grams, _ in blocks_of(batch):
                yield grams

        common = spark.sparkContext.broadcast(                        # 8 MB
            repeat_bitmaps(chosen.select("line"), hashes_of, (2,))[2][0])

        def run(batches):
            bits = common.value
            for block, grams, n in chain.from_iterable(map(blocks_of, batches)):
                s = pa.array(np.add.reduceat(in_bitmap(bits, grams).astype(np.int64), np.cumsum(n) - n))
                marks = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(n) + 1, dtype=np.int32) * np.int32(SENT // 64)),
                    pa.array(sketches(grams, n, SENT).ravel()))
                yield pa.RecordBatch.from_arrays([block.column("node"), pa.array(n, pa.int64()), s, s, marks],
                                                 names=["node", "n", "s", "rest", "sketch"])

        return chosen.mapInArrow(run, "node long, n long, s long, rest long, sketch array<long>")

    groups = clusters.link_components(scratch, buckets, verify, prepare, limits, alike=True)
    in_groups = spark.sparkContext.broadcast(fixed_bitmap(groups, "node"))

    def met_again(batches):
        for batch in batches:
            nodes, sizes = unpacked(batch.column("nodes"), np.uint64)
            keep = np.flatnonzero(in_bitmap(again.value, nodes) | in_bitmap(in_groups.value, nodes))
            row = pa.array(np.repeat(np.arange(len(sizes)), sizes // 8)[keep])
            yield pa.RecordBatch.from_arrays(
                [batch.column("k").take(row), batch.column("h").take(row),
                 pa.array(unpacked(batch.column("pos"), np.int32)[0][keep]), pa.array(signed(nodes[keep]))],
                names=["k", "h", "pos", "node"])

    # a line that occurs once and is in no group stays
    places = lines.select("k", "h", "pos", "nodes").mapInArrow(met_again, f"k {kind}, h long, pos int, node long")
    places = scratch.save(scratch.save(places, "places")
                          .join(groups, "node", "left").select(
        F.struct("k", "h", "pos").alias("place"), F.coalesce("comp", "node").alias("label")), "labelled")
    # written, so that AQE splits the join where a line is repeated very often
    firsts = scratch.save(places.groupBy("label").agg(F.min("place").alias("first"), F.count("*").alias("n"))
                          .where("n > 1").select("label", "first"), "firsts")
    return (places.join(firsts, "label").where("not (place <=> first)").select("place.k", "place.h", "place.pos")
            .groupBy("k", "h").agg(F.collect_set("pos").alias("drops")))


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                gram: int = GRAM, drop_emptied: bool = False, counts: tuple[str, str] | None = None) -> DataFrame:
    """The documents, same columns, without repeated lines.

    ``drop_emptied`` leaves out documents that lost lines and have no non-blank
    line left, short ones included; ``counts`` names two more columns: lines before, lines removed.
    """
    drops = line_drops(docs, key=key, text=text, min_chars=min_chars, gram=gram)
    tag = uuid.uuid4().hex[:8]                                   # names that cannot clash
    k, h, d = f"k_{tag}", f"h_{tag}", f"d_{tag}"
    drops = Scratch(docs.sparkSession, "drops").save(
        drops.select(F.col("k").alias(k), F.col("h").alias(h), F.col("drops").alias(d)), "drops")
    size = drops.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(d)), F.lit(0)).alias("lines")).first()
    if size["n"] <= MAX_BROADCAST[0] and size["lines"] <= MAX_BROADCAST[1]:
        drops = F.broadcast(drops)
    hashed = docs.withColumn(f"t_{tag}", F.xxhash64(F.col(text)))
    joined = hashed.join(drops, hashed[key].eqNullSafe(drops[k]) & (hashed[f"t_{tag}"] == drops[h]), "left")
    columns, whole, gone = docs.columns, hashed[text], F.col(d)
    place = columns.index(text)
    if drop_emptied:                                             # a removed line is never blank
        filled = F.filter(F.split(whole, "\n"), lambda x: x.rlike(_NOT_BLANK))
        joined = joined.where(gone.isNull() | (F.size(filled) > F.size(gone)))
    # split once: the array of one binds the lines to a name
    left = F.transform(F.array(F.split(whole, "\n")), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)), "\n"))[0]
    total = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    out = joined.select(
        *[F.when(gone.isNull(), whole).otherwise(left).alias(c) if i == place else hashed[c]
          for i, c in enumerate(columns)],
        F.coalesce(total, F.lit(0)).cast("long").alias(f"n_{tag}"),
        F.when(gone.isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long").alias(f"r_{tag}"))
    if counts:
        return out.withColumnsRenamed({f"n_{tag}": counts[0], f"r_{tag}": counts[1]})
    return out.drop(f"n_{tag}", f"r_{tag}")
