"""Connected components of candidate buckets, without all pairs of a bucket.

``link_components`` gets buckets (key, node, short): two nodes may be linked only
if they share a key that is *short* for the smaller of them.  ``verify`` decides
on pairs.  All pairs of a large bucket are never made:

1. Every node is tested against one *pivot* of its bucket, the node that shares
   most buckets with most others (linear in the buckets' rows).  What is linked
   is merged; a bucket within one component has nothing left to decide.  The pivot,
   tested against all of its bucket, leaves it.
2. Sets are bounded: of a node's n elements only s occur in any other node's set,
   and only ``rest`` of these are no keys.  So a pair overlaps in at most
   min(s, s') elements, and in at most as many as the keys it shares and the larger
   rest.  Where nodes have sketches (a bit set per element), the bits in which two
   differ are at most as many as the elements only one of them holds.  Nodes and
   pairs that cannot reach the similarity are dropped.
3. Further rounds of pivots follow while they help; then exactly the pairs that
   are left are tested, each at the first key that it shares.

Every pair of a bucket is tested, or connected, or proven not to be linked: the
components are those of all pairs.  Bounds are for Jaccard similarities of at least
4/5; for others, a caller gives its own ``pairs_left``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Pairs for each row of the open buckets up to which a pair may be made at each key
#: that it shares, and up to which they are left to the bounds; beyond, another round
#: of pivots comes first.
FEW, MANY = 4, 256


def _largest_first(edges: DataFrame) -> DataFrame:
    return (edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            .where("u <> v").distinct())


def _star_step(edges: DataFrame) -> DataFrame:
    """Large-star, then small-star: each a partial minimum per node and a join."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    stars = _largest_first(large)
    lowest = stars.groupBy("u").agg(F.min("v").alias("m"))
    small = (stars.join(lowest, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
             .union(lowest.select(F.col("u").alias("a"), F.col("m").alias("b"))))
    return _largest_first(small)


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u has one v, which has none: a further step changes nothing."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up > 1 or up = 1 and down = 1").isEmpty()


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, comp) of the nodes of ``edges`` (a, b); comp is the smallest node."""
    return _smallest(_stars(scratch, edges, name))


def _stars(scratch: Scratch, edges: DataFrame, name: str, steps: int | None = None) -> DataFrame:
    """Edges (u, v), u > v, with the components of ``edges`` (a, b).

    Union-find over tables, step by step until the edges are stars; with
    ``steps`` only so many, where a component may still be in several parts.
    """
    current = scratch.save(_largest_first(edges), f"{name}-0")
    step = 0
    while step != steps and (steps is not None or not _are_stars(current)):
        step += 1
        current = scratch.save(_star_step(current), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
    return current


def _smallest(stars: DataFrame) -> DataFrame:
    """(node, comp): each node's smallest neighbour or itself."""
    return (stars.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            .union(stars.select(F.col("v").alias("node"), F.col("v").alias("comp")))
            .groupBy("node").agg(F.min("comp").alias("comp")))


def _pivots(shared: DataFrame) -> DataFrame:
    """(key, pivot): of each bucket, the node with the most neighbours in all."""
    sized = shared                                           # may have its buckets' sizes
    if "size" not in shared.columns:
        sized = shared.join(shared.groupBy("key").agg(F.count("*").alias("size")), "key")
    weight = sized.groupBy("node").agg(F.sum("size").alias("w"))
    return (shared.join(weight, "node").groupBy("key")
            .agg(F.max(F.struct("w", "node")).alias("p")).select("key", F.col("p.node").alias("pivot")))


def link_components(scratch: Scratch, buckets: DataFrame, verify: Callable[[DataFrame], DataFrame],
                    prepare: Callable[[DataFrame], None], limits: Callable[[DataFrame], DataFrame] | None = None,
                    *, limits_known: bool = False, alike: bool = False, rounds: int = 3,
                    pairs_left: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, comp) of all nodes with a link; buckets: (key, node, short), repeats
    allowed.

    ``prepare`` gets the nodes that share a bucket, once; ``verify`` maps pairs
    (a, b), a < b, to those linked; ``limits`` maps nodes to (node, n, s, rest)
    and, where it has them, sketch (array of long): used at once if
    ``limits_known``, else when many pairs are left.  ``pairs_left`` maps the rows
    (key, node, short, label) of open buckets to the pairs still to be tested, in
    place of the pairs that ``limits`` leave.  ``alike``: all rows are short, none
    repeats, and ``rest`` counts every element, as no key is one; then of the
    buckets that hold the same nodes one is kept.
    """
    if alike:
        # dealt out once, for both sides of the join
        dealt = buckets.where("key is not null").select("key", "node").repartition("key")
        shared = scratch.save(dealt.join(_one_of_each(dealt), "key").withColumn("short", F.lit(True)), "shared")
    else:
        ends = (buckets.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
                .where("lo < hi").select("key"))
        shared = scratch.save(buckets.join(ends, "key").groupBy("key", "node").agg(F.bool_or("short").alias("short")),
                              "shared")
    prepare(shared.select("node"))
    led = scratch.save(shared.join(_pivots(shared), "key"), "led-0")
    tested = scratch.save(_ordered(_with_pivot(led)), "pairs-0")
    links = scratch.save(verify(tested), "links-0")
    rest, bounds, before = _followers(led), None, None
    if limits_known:
        bounds = scratch.save(limits(shared.select("node").distinct()).where("5 * s >= 4 * n"), "limits")
        rest = rest.join(bounds.select("node"), "node", "left_semi")
    for r in range(1, rounds + 1):
        links = _stars(scratch, links, f"parts-{r}", steps=2)
        comp = _smallest(links)
        links = links.select(F.col("u").alias("a"), F.col("v").alias("b"))
        labelled = rest.select("key", "node", "short").join(comp, "node", "left").select(
            "key", "node", "short", F.coalesce("comp", "node").alias("label"))
        rest = scratch.save(_open(labelled), f"open-{r}")
        left = _left(rest)
        if not left["rows"]:
            break
        many = left["cross"] > FEW * left["rows"]
        if bounds is None and not pairs_left:
            bounds = scratch.save(limits(rest.select("node").distinct()).where("5 * s >= 4 * n"), "limits")
            rest = scratch.save(_open(rest.join(bounds.select("node"), "node", "left_semi")), f"bounded-{r}")
        last = (left["cross"] <= MANY * left["rows"] or r == rounds
                or (before is not None and left["cross"] > 0.9 * before))
        before = left["cross"]
        if not last:
            led = scratch.save(rest.join(_pivots(rest), "key"), f"led-{r}")
            new, rest = _with_pivot(led), _followers(led)
        else:
            new = pairs_left(rest) if pairs_left else _pairs_left(rest, bounds, many, alike)
        fresh = scratch.save(_ordered(new).join(tested, ["a", "b"], "left_anti"), f"pairs-{r}")
        links = links.union(scratch.save(verify(fresh), f"links-{r}"))
        if last:
            break
        tested = tested.union(fresh)
    return scratch.save(components(scratch, links, "components"), "linked")


def _one_of_each(buckets: DataFrame) -> DataFrame:
    """(key, size) of the buckets of several nodes, of those with the same nodes the
    smallest: sets are told apart by their ends, sizes and 64 bits of their nodes' hashes."""
    sets = buckets.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"),
                                      F.bit_xor(F.xxhash64("node")).alias("x"), F.count("*").alias("size"))
    return sets.where("lo < hi").groupBy("lo", "hi", "x", "size").agg(F.min("key").alias("key")).select("key", "size")


def _with_pivot(led: DataFrame) -> DataFrame:
    return led.select(F.col("pivot").alias("a"), F.col("node").alias("b"))


def _followers(led: DataFrame) -> DataFrame:
    """The rows of buckets without their pivots, whose pairs are all tested."""
    return led.where("node <> pivot").select("key", "node", "short")


def _ordered(pairs: DataFrame) -> DataFrame:
    return (pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .where("a <> b").distinct())


def _pairs_left(rest: DataFrame, bounds: DataFrame, many: bool, alike: bool) -> DataFrame:
    """Pairs (a, b) of different labels in a bucket that the bounds leave."""
    one = full = rest.join(bounds, "node")
    columns = ["key", "node", "label", "n", "s", "rest"]
    needed = "9 * least(s, s2) >= 4 * (n + n2)"
    if "sketch" in bounds.columns:                           # elements not in common: a ninth of both at most
        columns = [*columns, "sketch"]
        needed += (" and 9 * aggregate(zip_with(sketch, sketch2, (x, y) -> bit_count(x ^ y)), 0, (t, d) -> t + d)"
                   " <= n + n2")
    if many:                                                 # each pair at its first key, if it shares enough
        keys = rest.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))
        one = full = full.join(keys, "node")
        columns = [*columns, "keys"]
        needed += (" and key = array_intersect(keys, keys2)[0] "
                   "and 9 * (size(array_intersect(keys, keys2)) + greatest(rest, rest2)) >= 4 * (n + n2)")
        order = "node < node2"
    else:
        one = full if alike else full.where("short")         # the same on both sides is dealt out once
        order = "(n < n2 or n = n2 and node <> node2)"
    two = full.select("key", *(F.col(c).alias(f"{c}2") for c in columns if c != "key"))
    return (one.select(*columns).join(two, "key").where(f"{order} and label <> label2 and {needed}")
            .select(F.col("node").alias("a"), F.col("node2").alias("b")))


def _open(labelled: DataFrame) -> DataFrame:
    """The rows of buckets with several labels.  Nodes of different labels have
    only such keys in common."""
    several = (labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
               .where("lo < hi").select("key"))
    return labelled.join(several, "key", "left_semi")


def _left(rest: DataFrame):
    """Rows of open buckets, and pairs of different labels in them."""
    per = rest.groupBy("key", "label").agg(F.count("*").alias("c"))
    return (per.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                 F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("sq")) / 2), F.lit(0.0)).alias("cross")).first())
