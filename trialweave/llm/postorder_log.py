"""Merkle manifest of a table, written as a postorder append log.

The rows of a group are the leaves of a tree, in key order; every run of ``FANOUT`` nodes of a
level is hashed into one node of the next, until one is left.  The roots of the groups are the
leaves of one more tree, whose root stands for the whole table.

1. One pass over the table leaves a digest of each row.  The digests alone are sorted by ranges,
   and the number of a leaf is its place in its range after the leaves of the ranges before, so
   a group that holds most of the rows is spread over many tasks.
2. Builders take aligned ranges of ``FANOUT ** LEVELS`` nodes and write the nodes above them in
   the order in which they are complete; their topmost nodes are the input of the next round.
3. A log addresses nodes by position.  The position of a node is the number of nodes complete
   before it, which follows from the sizes of complete subtrees alone: see ``positions``.
4. Proofs go from the root down: a block gets the siblings above its topmost node, reads its own
   nodes from the log at the positions of their siblings, and hands the longer paths on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.sources.stages import stage

FANOUT = 8
#: Levels that one builder completes; its block has FANOUT ** LEVELS nodes at the lowest.
LEVELS = 4
#: The tree over the groups; the names of the others begin with "-" or "=".
TOP = ""

_PATH = "array<struct<before:binary,after:binary>>"
_LOG = "tree string, n bigint, level int, i bigint, position bigint, block bigint, digest binary"
_KINDS = "tree string, block bigint, kind int, n bigint, level int, i bigint, position bigint, digest binary, other binary, path " + _PATH + ", subroot binary, root binary"
_PATHS = "tree string, block bigint, n bigint, path " + _PATH + ", subroot binary, root binary"


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def positions(level: int, i: np.ndarray, n: int) -> np.ndarray:
    """Places in the log of the nodes ``i`` of a level in a tree of ``n`` leaves.

    Before node ``i`` come the leaves it ends with, the nodes of the levels between that these
    complete, the ``i`` nodes before it on its level, and on the levels above the nodes whose
    last child comes before it.  A leaf ends with no other leaf.
    """
    i = np.asarray(i, np.int64)
    place = i.copy()
    if level:
        end = np.minimum((i + 1) * FANOUT**level, n)
        for low in range(level):
            place += -(-end // FANOUT**low)
    for above in range(1, height(n) - level + 1):
        place += i // FANOUT**above
    return place


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tree_name(group: Column) -> Column:
    """A group's name in order of its UTF-8 bytes, the null group first."""
    return F.when(group.isNull(), "-").otherwise(F.concat(F.lit("="), group.cast("string")))


def row_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of the values, each a dash if null, else its byte count, a colon and itself."""
    fields = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``i``, the place in the row's tree, and ``n``, the size of that tree."""
    laid = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    laid = laid.withColumn("at", F.monotonically_increasing_id())
    laid = stage(laid.withColumn("part", F.shiftright("at", 33)), "sorted-leaves")
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy("tree", "part").agg(F.count("*").alias("size"), F.min("at").alias("first"))
    # one row per range and tree
    sizes = sizes.select("tree", "part", "first", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"), F.sum("size").over(Window.partitionBy("tree")).alias("n"))
    return laid.join(sizes, ["tree", "part"]).withColumn("i", F.col("offset") + F.col("at") - F.col("first")).drop("part", "at", "first", "offset")


def _build(table: pa.Table, levels: int) -> pa.Table:
    """The nodes above one builder's own, and leaves themselves, in the order they are complete."""
    tree, block, n, base = (table[c][0].as_py() for c in ("tree", "block", "n", "level"))
    i = table["i"].to_numpy()
    order = np.argsort(i)
    digests = [table["digest"][int(k)].as_py().hex() for k in order]
    nodes = [(0, i[order], digests)] if base == 0 else []
    first, level, width = int(i.min()), base, -(-n // FANOUT**base)
    while level < base + levels and width > 1:
        digests = [_hash("".join(digests[k : k + FANOUT])) for k in range(0, len(digests), FANOUT)]
        first, level, width = first // FANOUT, level + 1, -(-width // FANOUT)
        nodes.append((level, first + np.arange(len(digests)), digests))
    depth = np.concatenate([np.full(len(x), k) for k, x, _ in nodes])
    spots = np.concatenate([positions(k, x, n) for k, x, _ in nodes])
    order = np.argsort(spots)
    flat = [d for *_, own in nodes for d in own]
    m = len(order)
    return pa.table(
        {
            "tree": pa.array([tree] * m, pa.string()),
            "n": pa.array([n] * m, pa.int64()),
            "level": pa.array(depth[order], pa.int32()),
            "i": pa.array(np.concatenate([x for _, x, _ in nodes])[order], pa.int64()),
            "position": pa.array(spots[order], pa.int64()),
            "block": pa.array([block] * m, pa.int64()),
            "digest": pa.array([bytes.fromhex(flat[k]) for k in order], pa.binary()),
        }
    )


def _block(levels: int) -> Column:
    return F.floor(F.col("i") / FANOUT**levels).cast("bigint").alias("block")


def append_log(leaves: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The log of ``(tree, n, i, digest)`` leaves: one written part a round, the leaves' first.

    A part has ``(tree, n, level, i, position, block, digest)``; a tree's last position is its
    root.  Rounds are few: by default each takes a 4096th of the nodes of the one before.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes, base, parts = leaves.select("tree", "n", F.lit(0).alias("level"), "i", "digest"), 0, []
    while True:
        built = nodes.select("*", _block(levels)).groupBy("tree", "block").applyInArrow(lambda t: _build(t, levels), _LOG)
        parts.append(stage(built, "postorder-log"))
        base += levels
        if most <= FANOUT**base:
            return parts
        nodes = parts[-1].where((F.col("level") == base) & (F.col("n") > FANOUT**base)).select("tree", "n", "level", "i", "digest")


def roots(parts: list[DataFrame]) -> DataFrame:
    """``(tree, n, digest)``: the last node of each tree."""
    last = parts[0].select("tree", "n", "i", "level", "digest")
    for part in parts[1:]:
        last = last.unionAll(part.select("tree", "n", "i", "level", "digest"))
    # powers of two, exact as doubles
    level, n = F.col("level"), F.col("n")
    is_top = (n <= F.pow(F.lit(float(FANOUT)), level)) & ((level == 0) | (n > F.pow(F.lit(float(FANOUT)), level - 1)))
    return last.where((F.col("i") == 0) & is_top).select("tree", "n", "digest")


def _nodes(table: pa.Table) -> tuple[pa.Table, pa.Table, dict]:
    kind = table["kind"].to_numpy()
    nodes, wanted, path = (table.filter(pa.array(kind == k)) for k in range(3))
    return nodes, wanted, path.to_pylist()[0]


def _siblings(nodes: pa.Table, base: int, levels: int, n: int) -> list[tuple[int, list[tuple[bytes, bytes]]]]:
    """For each level of a block its first node, and each node's siblings before and after it."""
    spots, level, i = (nodes[c].to_numpy() for c in ("position", "level", "i"))
    order = np.argsort(spots)
    spots, digests = spots[order], nodes["digest"]
    out = []
    for k in range(base, min(base + levels, height(n))):
        own = np.sort(i[level == k])
        width = -(-n // FANOUT**k)
        found = []
        for first in range(int(own[0]), int(own[-1]) + 1, FANOUT):
            at = np.searchsorted(spots, positions(k, np.arange(first, min(first + FANOUT, width)), n))
            run = [digests[int(order[x])].as_py() for x in at]
            found += [(b"".join(run[:x]), b"".join(run[x + 1 :])) for x in range(len(run))]
        out.append((int(own[0]), found))
    return out


def _way(siblings: list[tuple[int, list[tuple[bytes, bytes]]]], i: int, rest: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    way = []
    for first, found in siblings:
        way.append(found[i - first])
        i //= FANOUT
    return way + rest


def _descend(base: int, levels: int):
    """Paths of the nodes of level ``base`` in one block, from the path of its topmost node."""

    def run(table: pa.Table) -> pa.Table:
        nodes, _, top = _nodes(table)
        n, rest = top["n"], [(x["before"], x["after"]) for x in top["path"]]
        siblings = _siblings(nodes, base, levels, n)
        lowest = sorted((x, d) for x, k, d in zip(*(nodes[c].to_pylist() for c in ("i", "level", "digest")), strict=True) if k == base)
        ways = [[{"before": b, "after": a} for b, a in _way(siblings, x, rest)] for x, _ in lowest]
        path = pa.array(ways, pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())])))
        m = len(lowest)
        same = {c: [top[c]] * m for c in ("tree", "n", "subroot", "root")}
        # a leaf of the top tree is itself the root of a tree
        subroot = pa.array([d for _, d in lowest] if top["tree"] == TOP else same["subroot"], pa.binary())
        return pa.table(
            {"tree": pa.array(same["tree"], pa.string()), "block": pa.array([x for x, _ in lowest], pa.int64()), "n": pa.array(same["n"], pa.int64()), "path": path, "subroot": subroot, "root": pa.array(same["root"], pa.binary())}
        )

    return run


def _prove(table: pa.Table, levels: int) -> pa.Table:
    """Proofs of the wanted leaves of one block, and the root that each proof folds to."""
    nodes, wanted, top = _nodes(table)
    n = top["n"]
    rest = [(x["before"], x["after"]) for x in top["path"]]
    siblings = _siblings(nodes, 0, levels, n)
    numbers, leaves, others = (wanted[c].to_pylist() for c in ("i", "digest", "other"))
    proofs, folded = [], []
    for i, leaf, other in zip(numbers, leaves, others, strict=True):
        way = [(b.hex(), a.hex()) for b, a in _way(siblings, i, rest)]
        proofs.append(_hash("".join(b + a for b, a in way)))
        value = (leaf if other is None else other).hex()
        for b, a in way:
            value = _hash(b + value + a)
        folded.append(value)
    m = len(numbers)
    return pa.table(
        {
            "tree": pa.array([top["tree"]] * m, pa.string()),
            "i": wanted["i"],
            "leaf": pa.array([x.hex() for x in leaves], pa.string()),
            "subroot": pa.array([top["subroot"].hex()] * m, pa.string()),
            "root": pa.array([top["root"].hex()] * m, pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()),
            "folded_root": pa.array(folded, pa.string()),
        }
    )


def _kind(rows: DataFrame, kind: int) -> DataFrame:
    """Rows in the one form in which nodes, wanted leaves and paths meet in a block's task."""
    rows = rows.withColumn("kind", F.lit(kind))
    fields = (x.split(" ", 1) for x in _KINDS.split(", "))
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in fields))


def paths(parts: list[DataFrame], entry: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Paths ``(tree, block, n, path, subroot, root)`` of the blocks of leaves.

    ``entry`` has the paths of the trees' roots.  A tree enters in the round that wrote its root.
    """
    open_ = None
    for r in range(len(parts) - 1, 0, -1):
        base = r * levels
        enters = F.col("n") > FANOUT**base
        if r < len(parts) - 1:
            enters &= F.col("n") <= FANOUT ** (base + levels)
        tops = entry.where(enters) if open_ is None else open_.unionByName(entry.where(enters))
        lowest = parts[r - 1].where((F.col("level") == base) & (F.col("n") > FANOUT**base)).withColumn("block", _block(levels))
        both = _kind(parts[r], 0).unionAll(_kind(lowest, 0)).unionAll(_kind(tops, 2))
        open_ = stage(both.groupBy("tree", "block").applyInArrow(_descend(base, levels), _PATHS), "paths")
    return entry if open_ is None else open_.unionByName(entry.where(F.col("n") <= FANOUT**levels))


def proofs(leaves: DataFrame, parts: list[DataFrame], top: list[DataFrame], groups: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``(tree, i, leaf, subroot, root, proof_sha256, folded_root)`` of leaves ``(tree, i, digest, other)``.

    ``parts`` is the log of the groups, ``top`` that of the tree over them, ``groups`` its
    leaves with the ``name`` of each.  Where ``other`` is not null, it takes the leaf's place
    when the proof is folded.
    """
    nothing = F.from_json(F.lit("[]"), _PATH)
    one = roots(top).select("tree", F.lit(0).cast("bigint").alias("block"), "n", nothing.alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    blocks = _kind(top[0], 0).unionAll(_kind(paths(top, one, levels), 2)).groupBy("tree", "block")
    of_groups = stage(blocks.applyInArrow(_descend(0, levels), _PATHS), "paths")
    entry = of_groups.select(F.col("block").alias("i"), "path", "subroot", "root").join(groups.select("i", F.col("name").alias("tree"), "size"), "i")
    entry = entry.select("tree", F.lit(0).cast("bigint").alias("block"), F.col("size").alias("n"), "path", "subroot", "root")
    each = _kind(parts[0], 0).unionAll(_kind(leaves.select("*", _block(levels)), 1)).unionAll(_kind(paths(parts, stage(entry, "paths"), levels), 2))
    kinds = "tree string, i bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return each.groupBy("tree", "block").applyInArrow(lambda t: _prove(t, levels), kinds)


def manifest(docs: DataFrame, columns: Sequence[str], group: str = "lang", key: str = "doc_id", tampered: dict[str, Column] | None = None, when: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """``(key, leaf, subroot, root, proof_sha256, folded_root, verified)``, one row per row.

    A leaf is the digest of the row's ``columns``.  Within a group, leaves are in the order of
    the key, a null key first and rows of one key by digest; groups are in the order of their
    names' bytes, a null group first.  ``proof_sha256`` is the digest of the leaf's siblings
    from its own level up to the root.  ``tampered`` replaces columns in the rows where ``when``
    holds: of those rows ``folded_root`` is what the changed row's digest folds to with the
    untampered siblings, so ``verified`` tells whether the change shows.  Nulls in any column
    are values of their own, an empty text is not a null; equal rows are separate leaves with
    equal digests; other columns don't matter.  An empty table gives no rows.
    """
    tampered = tampered or {}
    changed = F.lit(None).cast("binary")
    if when is not None:
        changed = F.when(when, row_digest([tampered.get(c, F.col(c)) for c in columns]))
    rows = docs.select(tree_name(F.col(group)).alias("tree"), F.col(key).alias("k"), row_digest([F.col(c) for c in columns]).alias("digest"), changed.alias("other"))
    leaves = stage(_numbered(stage(rows, "row-digests"), ["k", "digest"]), "leaves")
    parts = append_log(leaves, levels)
    own = roots(parts).select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), F.col("n").alias("size"), "digest")
    groups = stage(_numbered(stage(own, "groups"), ["name"]), "groups")
    found = proofs(leaves, parts, append_log(groups, levels), groups, levels)
    named = leaves.select("tree", "i", F.col("k").alias(key)).join(found, ["tree", "i"])
    return named.select(key, "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
