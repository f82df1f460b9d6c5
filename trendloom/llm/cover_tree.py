"""Exact top-k inner-product search with dual cover trees.

Vectors are quantised to integers, floor(64 x), and scored by their integer inner
product.  Queries and data are indexed together: a farthest-first set of pivots
of a bounded sample is the top level of both trees, every vector goes to its
nearest pivot.  Below, the vectors of a pivot are dealt into parts of bounded size,
queries and data apart, each with a cover tree: a node has a centre, a covering
radius and children, whose centres are chosen farthest first until they cover it
with half the radius, or are ``FAN``; their radii are those measured.

For a query node Q (centre c, radius r) and a data node D (centre d, radius s)
no inner product exceeds  c.d + r |d| + s |c| + r s.  A pair of nodes whose bound
is below the worst k-th score of Q's queries is pruned; of another pair the node
with the larger radius is replaced by its children, best bounds first, and two
leaves meet in a matrix product.  The k-th scores start from the sample (a subset of
the candidates, so a valid bound) and rise as the search goes on.

Pairs of pivots are tested first, on counts, radii and least k-th scores of their
cells: only the query parts of pairs that are left are sent to a data part.  The data
are shuffled once; the queries once for every data part that they may have a
neighbour in.  Rows travel one by one, sorted by part, so that a task holds one data
part and one query part at a time and returns at most k rows a query.

Edge cases: vectors that are null or hold a null, NaN or infinity take no part,
nor do those of a length other than the most frequent one (of equally frequent
ones the smallest); rows with a null id take no part; a query's own id is no
candidate; rows that repeat an id are candidates each, the query of that id runs
once (with its smallest vector); ties go to the smaller id; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SCALE = 64
PIVOTS = 48
SAMPLE = 4096                    # vectors the driver reads
BLOCK = 16_384                   # vectors of a data part, about
QUERY_GROUP = 4096               # queries of a query part, about
FAN, LEAF = 8, 128               # children of a node at most; vectors of a leaf


def quantise(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x.astype(np.float64))


class Node:
    __slots__ = ("rows", "centre", "radius", "norm", "children")

    def __init__(self, rows, centre, radius):
        self.rows, self.centre, self.radius = rows, centre, radius
        self.norm, self.children = float(np.sqrt(centre @ centre)), []


def _distances(x: np.ndarray, sq: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(sq - 2 * (x @ c) + c @ c, 0))


def cover_tree(x: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> Node:
    """Cover tree over the rows of x."""
    sq = (x * x).sum(axis=1)

    def build(rows, first, distance):
        node = Node(rows, x[first], float(distance.max(initial=0)) * (1 + 1e-9) + 1e-6)
        if len(rows) <= leaf or node.radius <= 1e-3:
            return node
        centres, near, owner = [first], distance.copy(), np.zeros(len(rows), dtype=int)
        while near.max() > node.radius / 2 and len(centres) < fan:
            new = int(near.argmax())
            d = _distances(x[rows], sq[rows], x[rows[new]])
            owner[d < near] = len(centres)
            near = np.minimum(near, d)
            centres.append(int(rows[new]))
        for j, c in enumerate(centres):
            if (mine := owner == j).any():
                node.children.append(build(rows[mine], c, near[mine]))
        return node

    if not len(x):
        return Node(np.arange(0), np.zeros(x.shape[1]), 0.0)
    return build(np.arange(len(x)), 0, _distances(x, sq, x[0]))


def largest(c: np.ndarray, r: float, d: np.ndarray, s: float) -> float:
    """No inner product of vectors within r of c and within s of d is above this."""
    b = float(c @ d) + r * float(np.sqrt(d @ d)) + s * float(np.sqrt(c @ c)) + r * s
    return b + 1e-6 * abs(b) + 1e-3


def bound(q: Node, d: Node) -> float:
    b = float(q.centre @ d.centre) + q.radius * d.norm + d.radius * q.norm + q.radius * d.radius
    return b + 1e-6 * abs(b) + 1e-3


class TopK:
    """Best k (score, id) of every query, found block by block."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.k, self.worst = ids, k, floor.astype(np.float64).copy()
        self.kept = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        hit = (scores >= self.worst[rows][:, None]) & (ids[None, :] != self.ids[rows][:, None])
        for i in np.flatnonzero(hit.any(axis=1)):
            r, h = rows[i], hit[i]
            s = np.concatenate((self.kept[r][0], scores[i, h].astype(np.int64)))
            n = np.concatenate((self.kept[r][1], ids[h]))
            if len(s) > self.k:
                best = np.lexsort((n, -s))[:self.k]
                s, n = s[best], n[best]
            if len(s) == self.k:
                self.worst[r] = max(self.worst[r], float(s.min()))
            self.kept[r] = (s, n)


def search(qtree: Node, q: np.ndarray, dtree: Node, d: np.ndarray, ids: np.ndarray, top: TopK) -> int:
    """Dual-tree search of a data tree for a query tree, by pairs of nodes; returns
    how many pairs of vectors were multiplied."""
    made = 0
    stack = [(bound(qtree, dtree), qtree, dtree)]
    while stack:
        b, qn, dn = stack.pop()
        if b < top.worst[qn.rows].min(initial=np.inf):
            continue
        if not qn.children and not dn.children:
            made += len(qn.rows) * len(dn.rows)
            top.offer(qn.rows, q[qn.rows] @ d[dn.rows].T, ids[dn.rows])
            continue
        if dn.children and (not qn.children or dn.radius >= qn.radius):
            below = [(bound(qn, c), qn, c) for c in dn.children]
        else:
            below = [(bound(c, dn), c, dn) for c in qn.children]
        stack.extend(sorted(below, key=lambda e: e[0]))              # the best bound is taken first
    return made


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Rows of x that cover it, each the farthest from those before it."""
    sq = (x * x).sum(axis=1)
    chosen, near = [0], _distances(x, sq, x[0])
    while len(chosen) < min(k, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, sq, x[chosen[-1]]))
    return x[chosen]


def _exact(norms: np.ndarray, data: np.ndarray) -> type:
    """float32 where every partial sum of a product is an exact integer there."""
    return np.float32 if norms.max(initial=0) * data.max(initial=0) < 1 << 24 else np.float64


def top_k(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 20,
          is_query=None, block: int = BLOCK, group: int = QUERY_GROUP) -> DataFrame:
    """query_id, rank, vec_id, score of the queries (by default ids divisible by 20)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "cover")
    is_query = F.pmod(F.col("vec_id"), F.lit(20)) == 0 if is_query is None else is_query
    fine = (F.col(vector).isNotNull() & F.col(key).isNotNull()
            & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    rows = vectors.where(fine).select(
        F.col(key).cast("long").alias("vec_id"),
        F.transform(vector, lambda c: F.floor(SCALE * c.cast("double")).cast("double")).alias("x"))
    size = (rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first() or [0])[0]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not size:
        return empty
    rows = rows.where(F.size("x") == size)

    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()   # SAMPLE rows
    sample_ids = sample.column("vec_id").to_numpy()
    sample_x = _vectors(sample.column("x").combine_chunks(), size)
    pivots = spark.sparkContext.broadcast(_farthest_first(sample_x, PIVOTS))

    def nearest(batches):
        p = pivots.value
        for batch in batches:
            x = _vectors(batch.column("x"), size)
            d = np.maximum((x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * (x @ p.T), 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(np.sqrt(d.min(axis=1)))],
                names=["vec_id", "x", "pivot", "far"])

    data = scratch.save(rows.mapInArrow(nearest, "vec_id long, x array<double>, pivot int, far double")
                        .withColumn("part", F.xxhash64(F.monotonically_increasing_id())), "data")
    held = spark.sparkContext.broadcast((sample_ids, sample_x))

    def floors(batches):
        """The k-th best score of every query within the sample."""
        ids, x = held.value
        for batch in batches:
            out = []
            for begin in range(0, batch.num_rows, 256):
                some = batch.slice(begin, 256)
                s = _vectors(some.column("x"), size) @ x.T
                s[some.column("vec_id").to_numpy()[:, None] == ids[None, :]] = -np.inf
                out.append(np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(s), -np.inf))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.empty(0))],
                                             names=["vec_id", "x", "pivot", "far", "floor"])

    queries = (data.where(is_query).groupBy("vec_id").agg(F.min(F.struct("x", "pivot", "far")).alias("q"))
               .select("vec_id", "q.x", "q.pivot", "q.far"))
    queries = scratch.save(queries.mapInArrow(
        floors, "vec_id long, x array<double>, pivot int, far double, floor double"), "queries")

    # the top of both trees: PIVOTS cells each, with counts, radii and least k-th scores
    cells = {r["pivot"]: (r["n"], r["far"]) for r in
             data.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    asked = {r["pivot"]: (r["n"], r["far"], r["floor"]) for r in
             queries.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("far"),
                                          F.min("floor").alias("floor")).collect()}
    if not asked:
        return empty
    top_level, slack = pivots.value, 1 + 1e-9
    pairs = [(q, d) for q, (_, r, least) in asked.items() for d, (_, s) in cells.items()
             if largest(top_level[q], r * slack + 1e-6, top_level[d], s * slack + 1e-6) >= least]

    def dealt(counts: dict[int, int], most: int) -> tuple[F.Column, F.Column]:
        """Of a row's pivot, how many parts it has and the number of the first."""
        several = {p: -(-n // most) for p, n in counts.items()}
        first = dict(zip(several, np.cumsum([0, *several.values()]).tolist()))
        return tuple(F.element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), F.col("pivot"))
                     for values in (several, first))

    several, first = dealt({p: n for p, (n, _) in cells.items()}, block)
    parts = data.select((first + F.pmod("part", several)).cast("int").alias("task"), F.lit(0).alias("kind"),
                        F.lit(0).alias("grp"), "vec_id", "x", F.lit(0.0).alias("floor"))
    in_groups, first_group = dealt({p: n for p, (n, _, _) in asked.items()}, group)
    groups = queries.withColumn("grp", (first_group + F.pmod(F.xxhash64("vec_id"), in_groups)).cast("int"))
    left = spark.createDataFrame(pairs, "asked int, pivot int")                     # PIVOTS ** 2 rows at most
    sent = (groups.withColumnRenamed("pivot", "asked").join(F.broadcast(left), "asked")
            .withColumn("task", F.explode(F.sequence(first, first + several - 1)))
            .select(F.col("task").cast("int"), F.lit(1).alias("kind"), "grp", "vec_id", "x", "floor"))

    def dual(batches):
        """Rows come by task: its data part, then its query parts one after the other."""
        data_part = None
        for (task, kind, _), ids, x, floor in _segments(batches, size):
            if kind == 0:
                data_part = task, ids, x, cover_tree(x), np.sqrt((x * x).sum(axis=1))
                continue
            if data_part is None or data_part[0] != task:
                continue                                             # a part without data
            exact = _exact(np.sqrt((x * x).sum(axis=1)), data_part[4])
            top = TopK(ids, floor, k)
            search(cover_tree(x), x.astype(exact), data_part[3], data_part[2].astype(exact), data_part[1], top)
            for own, (s, n) in zip(ids, top.kept):
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), own)), pa.array(n), pa.array(s)],
                                                     names=["query_id", "vec_id", "score"])

    best = (parts.union(sent).repartition("task").sortWithinPartitions("task", "kind", "grp")
            .mapInArrow(dual, "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _segments(batches, size: int):
    """((task, kind, grp), ids, vectors, floors) of rows sorted by these three."""
    key, held = None, []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("task", "kind", "grp")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for begin, end in zip(cuts[:-1], cuts[1:]):
            if begin == end:
                continue
            if key is not None and key != tuple(keys[begin]):
                yield key, *map(np.concatenate, zip(*held))
                held = []
            key = tuple(keys[begin])
            some = batch.slice(begin, end - begin)
            held.append((some.column("vec_id").to_numpy(), _vectors(some.column("x"), size),
                         some.column("floor").to_numpy()))
    if held:
        yield key, *map(np.concatenate, zip(*held))
