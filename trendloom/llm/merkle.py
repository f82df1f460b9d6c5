"""A Merkle manifest of a dataset by sibling-shift self-joins.

Every row is a leaf: the SHA-256 of some of its columns, each written as ``-`` if
null, else as its number of UTF-8 bytes, ``:`` and the value.  The leaves of a
group (a source) are ordered by key and numbered from 0; the nodes of a level stand
in runs of ``arity``, and the hash of a run's digests (hexadecimal text, left to
right) is their parent, until one node, the group's *subroot*, is left.  The
subroots, ordered by group, give the *root* in the same way.

Each level is a table of nodes (group number, index).  A node joins its siblings by
their indices, which its own tells: ``i XOR 1`` in a binary tree, else the run's
first index plus ``(slot + k) mod arity`` for every offset k.  The rows of slot
zero then hold all of their run and emit the parents.  Keys of these joins are
unique, so no group is hot, however many rows it holds, and a level has a third of
the rows (1 / arity) of the one below.

Indices come from a range partitioning by group and key: counts for each partition
and group are summed over the partitions before, so that a large group is numbered
by many tasks.

A row's *proof* is the list of its siblings left and right of it, level by level up
to the root.  It is handed down from parents to children, one join a level; folding
it over a leaf gives the root again if neither row nor proof was changed.

Edge cases: groups that are null come first and form one group; a null key comes
first within its group; rows that repeat a key are ordered by their digest; equal
rows are leaves of their own; a group of one row has its leaf as subroot; with a
single row in all that leaf is the root and the proof is empty; an empty table gives
an empty manifest; other columns are ignored unless they are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

ARITY = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*values: Column) -> Column:
    """The digest of a row's values, in hexadecimal."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts)), 256)


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _parent(*digests: Column) -> Column:
    """The digest, as binary, of the texts of binary digests."""
    return F.unhex(F.sha2(F.concat(*map(_hex, digests)), 256))


def _numbered(scratch: Scratch, rows: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """The rows with ``i``, their place in their group from 0, and ``c``, the
    group's number of rows."""
    by = [*groups, *order]
    placed = scratch.save(rows.repartitionByRange(*by).sortWithinPartitions(*by)
                          .withColumn("at", F.monotonically_increasing_id())
                          .withColumn("part", F.shiftrightunsigned("at", 33)), name)
    counts = placed.groupBy(*groups, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # a window has a row for each partition that its group lies in
    group = Window.partitionBy(*groups)
    earlier = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.select(*(F.col(g).alias(f"{g}_") for g in groups), F.col("part").alias("part_"), "first",
                         F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                         F.sum("n").over(group).alias("c"))
    same = placed["part"] == runs["part_"]
    for g in groups:
        same = same & placed[g].eqNullSafe(runs[f"{g}_"])
    return placed.join(runs, same).withColumn("i", F.col("at") - F.col("first") + F.col("before")).select(
        *rows.columns, "i", "c")


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (g, i, c, h, ...) with ``l`` and ``r``, the digests of their run left
    and right of them, joined together."""
    slot, nothing = F.col("i") % arity, F.lit(b"")
    out = nodes
    for k in range(1, arity):
        sibling = F.col("i").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("i") - slot + (slot + k) % arity
        shifted = nodes.select(F.col("g").alias(f"g{k}"), F.col("i").alias(f"i{k}"), F.col("h").alias(f"h{k}"))
        out = out.withColumn(f"s{k}", sibling)
        out = out.join(shifted, (out["g"] == shifted[f"g{k}"]) & (out[f"s{k}"] == shifted[f"i{k}"]), "left")
    by_offset = F.array(nothing, *(F.coalesce(f"h{k}", nothing) for k in range(1, arity)))
    left = [F.when(slot > t, F.get(by_offset, t - slot + arity)).otherwise(nothing) for t in range(arity - 1)]
    right = [F.when(slot < t, F.get(by_offset, t - slot)).otherwise(nothing) for t in range(1, arity)]
    return out.select(*nodes.columns, F.concat(*left).alias("l"), F.concat(*right).alias("r"))


def _climb(scratch: Scratch, nodes: DataFrame, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """From the nodes (g, i, c, h, ...) of level 0: the levels, as tables of the
    nodes that have a parent, with l and r; and the last node of each group, with
    the level where it stands: (g, h, level)."""
    most = nodes.agg(F.max("c")).first()[0] or 0
    levels = []
    tops = nodes.where("c = 1").select("g", "h", F.lit(0).alias("level"))
    while most > 1:
        level = scratch.save(_with_siblings(nodes.where("c > 1"), arity), f"{name}-{len(levels)}")
        levels.append(level)
        nodes = level.where(F.col("i") % arity == 0).select(
            "g", F.expr(f"i div {arity}").alias("i"), F.expr(f"(c + {arity - 1}) div {arity}").alias("c"),
            _parent(F.col("h"), F.col("r")).alias("h"))
        tops = tops.union(nodes.where("c = 1").select("g", "h", F.lit(len(levels))))
        most = -(-most // arity)
    return levels, scratch.save(tops, f"{name}-tops")


def _descend(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The nodes of level 0 with their path (siblings left and right, level by
    level) and subroot; tops: (g, level, path, subroot)."""
    def ended(level: int) -> DataFrame:
        return tops.where(F.col("level") == level).select("g", F.lit(0).cast("long").alias("i"), "path", "subroot")

    above = ended(len(levels))
    for level in reversed(range(len(levels))):
        rows = levels[level].withColumn("up", F.expr(f"i div {arity}"))
        above = above.select(F.col("g").alias("g_"), F.col("i").alias("i_"), "path", "subroot")
        here = rows.join(above, (rows["g"] == above["g_"]) & (rows["up"] == above["i_"]))
        here = here.select(*([] if level else [c for c in rows.columns if c not in ("up", "l", "r", "c", "g", "i")]),
                           "g", "i", F.concat(F.array(F.struct("l", "r")), "path").alias("path"), "subroot")
        above = here.union(ended(level)) if level else here
    return above


def build_manifest(docs: DataFrame, *, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = COLUMNS,
                   arity: int = ARITY, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: key, the carried columns, leaf, subroot, root
    (hexadecimal) and path, an array of (l, r) with the binary digests of the
    siblings left and right, from the leaf's level to the root's."""
    if arity < 2:
        raise ValueError("arity must be 2 at least")
    carry = carry or {}
    scratch = Scratch(docs.sparkSession, "merkle")
    leaves = scratch.save(docs.select(
        F.col(group).alias("grp"), F.col(key).alias("key"), F.unhex(leaf_hash(*(F.col(c) for c in columns))).alias("h"),
        *(v.alias(f"carry_{n}") for n, v in carry.items())), "leaves")
    numbered = scratch.save(_numbered(scratch, leaves, ["grp"], ["key", "h"], "placed"), "numbered")
    groups = numbered.where("i = 0").select("grp")
    groups = scratch.save(_numbered(scratch, groups, [], ["grp"], "groups").select(
        F.col("grp").alias("grp_"), F.col("i").alias("g")), "group-numbers")
    carried = [f"carry_{n}" for n in carry]
    # groups are few beside rows; a large one's rows are split by AQE
    nodes = scratch.save(numbered.join(groups, numbered["grp"].eqNullSafe(groups["grp_"]))
                         .select("g", "i", "c", "h", "key", *carried), "nodes")
    levels, tops = _climb(scratch, nodes, arity, "level")
    no_path = F.array().cast("array<struct<l:binary,r:binary>>").alias("path")
    top_nodes = scratch.save(tops.select(F.lit(0).alias("g"), F.col("g").alias("i"), F.lit(groups.count()).cast("long")
                                         .alias("c"), "h", F.col("g").alias("grp"), "level"), "top-nodes")
    top_levels, root = _climb(scratch, top_nodes, arity, "top")
    root_row = root.first()
    if not top_levels:                                        # one group, or none
        tops = tops.select("g", "level", no_path, F.col("h").alias("subroot"))
    else:
        tops = _descend(top_levels, root.select("g", F.col("level"), no_path, F.col("h").alias("subroot")), arity)
        tops = scratch.save(tops.select(F.col("grp").alias("g"), "level", "path", F.col("h").alias("subroot")), "tops")
    if levels:
        paths = _descend(levels, tops, arity).select("key", *carried, "h", "path", "subroot")
        lone = nodes.where("c = 1")
    else:
        paths, lone = None, nodes
    alone = lone.join(tops.select(F.col("g").alias("g_"), "path", "subroot"), F.col("g") == F.col("g_")).select(
        "key", *carried, "h", "path", "subroot")
    rows = alone if paths is None else paths.union(alone)
    return rows.select(F.col("key").alias(key), *(F.col(f"carry_{n}").alias(n) for n in carry),
                       _hex(F.col("h")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"),
                       _hex(F.lit(bytes(root_row["h"]) if root_row else b"")).alias("root"), "path")


def proof_hash(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: _hex(F.concat(s["l"], s["r"]))), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(_hex(s["l"]), h, _hex(s["r"])), 256))


def verify(manifest: DataFrame, docs: DataFrame, *, key: str = "doc_id",
           columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(key, verified) of the rows of ``docs``, whose keys are unique: whether row
    and proof lead to the manifest's root; null where the manifest has no such key."""
    now = docs.select(F.col(key), leaf_hash(*(F.col(c) for c in columns)).alias("now"))
    known = manifest.select(F.col(key).alias("known_key"), "path", "root")
    return now.join(known, now[key].eqNullSafe(known["known_key"]), "left").select(
        now[key], (fold(F.col("now"), F.col("path")) == F.col("root")).alias("verified"))


def check_manifest(docs: DataFrame, altered: dict[str, Column] | None = None, *, key: str = "doc_id",
                   columns: tuple[str, ...] = COLUMNS, **options) -> DataFrame:
    """The manifest of ``docs`` and what its proofs say of the rows once the
    columns named in ``altered`` hold those values instead: key, leaf, subroot,
    root, proof_sha256, folded_root, verified."""
    now = leaf_hash(*((altered or {}).get(c, F.col(c)) for c in columns))
    rows = build_manifest(docs, key=key, columns=columns, carry={"now": now}, **options)
    rows = rows.withColumn("folded_root", fold(F.col("now"), F.col("path")))
    return rows.select(key, "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))
