"""N-gram Jaccard join of whole documents with signature trees; exact up to 64-bit hashes.

1. A pass over the texts keeps of each document its number of distinct shingles, a digest of
   its words, and the shingles in the lowest part of the hash range.  Equal texts become one
   representative.
2. Two documents that link share one of their rarest shingles.  Frequencies of the kept
   shingles are counted over all representatives, and each keeps as many of its rarest ones
   as the similarity asks for.  Documents whose rarest shingles occur nowhere else are done.
3. Documents that agree in their smallest or their largest shingle are compared first, in
   parts of ``LEAF`` or so, each with the next; most groups of near copies are then components.
4. All documents stand in one order: by the most frequent of their rare shingles, by component,
   by size.  ``NODE`` neighbours are a leaf and ``FANOUT`` neighbouring nodes one of the next
   level, with the OR of their documents' token bitmaps, their range of sizes and of
   components.  Bitmaps grow with the document; a node has the narrowest width below it.
5. Rare shingles that stand in nearly the same leaves are followed as one.  Each is followed
   from the lowest level at which ``FANOUT`` nodes hold its documents.  Pairs of nodes go down level by level, to children that hold the shingle, as
   long as the largest possible overlap can reach the similarity and the two are not one
   component.  The sets in the remaining pairs of leaves are compared, each fetched once for
   all the pairs of two parents.
6. Only links that join components leave a task; components are found by star contraction.

Joins have one form at every size: tables of broadcast joins, each with memory pages of its
own, stayed in the executors from step to step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.components import connected_components
from trialweave.llm.filters import may_match, shown_key, whole_key
from trialweave.llm.words import LOWER, SPACE, Hasher, mix, runs, shingles, text_slices
from trialweave.llm.workers import giving_back
from trialweave.sources.stages import stage

#: Documents that are compared together before the trees are built.
LEAF = 256
#: Documents of a leaf, as a power of two, and children of a node.
NODE_BITS, FANOUT_BITS = 4, 3
FANOUT = 1 << FANOUT_BITS
#: Levels of nodes that one task builds.
LEVELS = 3
#: A signature has 2 ** BITS bits for 512 shingles, and twice as many with each doubling.
BITS, WIDTHS = 10, 8


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int, hasher: Hasher) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document; fewer words than ``width`` are one shingle."""
    data = LOWER[data]
    start, end, doc = runs(data, offsets, SPACE)
    hashes = hasher.spans(data, start, end)
    value, at = shingles(hashes, doc, width)
    edges = np.searchsorted(doc[at], np.arange(len(offsets)))
    words = np.searchsorted(doc, np.arange(len(offsets)))
    for i in range(len(offsets) - 1):
        n = words[i + 1] - words[i]
        if 0 < n < width:
            whole, _ = shingles(hashes[words[i] : words[i + 1]], np.zeros(n, np.int64), int(n))
            yield mix(whole + np.uint64(n))
        else:
            yield np.unique(value[edges[i] : edges[i + 1]])


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _sketch(docs: DataFrame, width: int, percent: int, counted: int) -> DataFrame:
    """``(k, n, digest, counted, tokens)`` of each document; tokens below ``counted`` or its smallest ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part, data, offsets in text_slices(batch, "t"):
                whole = LOWER[data].tobytes()
                sizes, below, digests, tokens = [], [], [], []
                for i, own in enumerate(shingle_sets(data, offsets, width, hasher)):
                    n = len(own)
                    needed = n - -(-percent * n // 100) + 1 if n else 0
                    low = int(np.searchsorted(own, np.uint64(counted)))
                    sizes.append(n)
                    below.append(low)
                    tokens.append(own[: max(low, needed)])
                    digests.append(hashlib.sha256(b" ".join(whole[offsets[i] : offsets[i + 1]].split())).digest())
                edges = pa.array(np.append(0, np.cumsum([len(x) for x in tokens])), pa.int32())
                flat = pa.array(_signed(np.concatenate(tokens)))
                yield pa.RecordBatch.from_arrays(
                    [part["k"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(below, pa.int64()), pa.ListArray.from_arrays(edges, flat)],
                    ["k", "n", "digest", "counted", "tokens"],
                )

    return docs.mapInArrow(giving_back(run), "k bigint, n bigint, digest binary, counted bigint, tokens array<bigint>")


def _prefix(reps: DataFrame, percent: int, counted: int) -> DataFrame:
    """``(rep, token)``: the rarest tokens of each representative that another one has too."""
    tokens = reps.select("rep", "n", "counted", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = tokens.join(shared.hint("merge"), "token")
    needed = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    is_counted = (F.col("token") >= 0) & (F.col("token") < counted)
    each = own.groupBy("rep", "n", "counted").agg(
        F.sort_array(F.collect_list(F.struct(~is_counted, "df", "token"))).alias("own"),
        F.count_if(is_counted).alias("shared"),
    )
    # tokens of one document come first in the order, then the shared ones by frequency
    take = F.when(F.col("counted") >= needed, F.greatest(needed - (F.col("counted") - F.col("shared")), F.lit(0))).otherwise(F.size("own"))
    return each.select("rep", F.explode(F.slice("own", F.lit(1), take.cast("int"))).alias("x")).select("rep", F.col("x.token").alias("token"))


def _candidate_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``(k, n, least, most, slack, sig, set)`` of the documents in ``members``, read from their texts.

    Few other texts are shuffled to the join, thanks to a bounded filter of the wanted ids.
    """
    docs = may_match(docs, "k", members, "near").where("near")
    rows = docs.select("k", "t").join(members.hint("merge"), "k").select("k", "t").dropDuplicates(["k", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part, data, offsets in text_slices(batch, "t"):
                own = list(shingle_sets(data, offsets, width, hasher))
                signs = [signature(x) for x in own]
                columns = [
                    part["k"],
                    pa.array([len(x) for x in own], pa.int64()),
                    pa.array([int(_signed(x)[0]) if len(x) else 0 for x in own], pa.int64()),
                    pa.array([int(_signed(x)[-1]) if len(x) else 0 for x in own], pa.int64()),
                    pa.array([x for _, x in signs], pa.list_(pa.int64())),
                    pa.array([x.tobytes() for x, _ in signs], pa.binary()),
                    pa.array([x.tobytes() for x in own], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["k", "n", "least", "most", "slack", "sig", "set"])

    return rows.mapInArrow(giving_back(run), "k bigint, n bigint, least bigint, most bigint, slack array<bigint>, sig binary, set binary")


def fold(sig: np.ndarray) -> np.ndarray:
    """Signatures, the last axis in bytes, at half the width."""
    bits = np.unpackbits(sig, axis=-1)
    return np.packbits(bits[..., ::2] | bits[..., 1::2], axis=-1)


def signature(tokens: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Bitmap of a set's tokens by their leading bits, and at each width up to its own how many tokens share a bit."""
    width = min((max(len(tokens) - 1, 0) // 512).bit_length(), WIDTHS - 1)
    bits = np.zeros(1 << (BITS + width), bool)
    bits[(tokens >> np.uint64(64 - BITS - width)).astype(np.int64)] = True
    sig, slack = np.packbits(bits), [0] * WIDTHS
    for w in range(width, -1, -1):
        slack[w] = len(tokens) - int(bits.sum())
        bits = bits[::2] | bits[1::2]
    return sig, slack


def similar(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of two lists reach the similarity, as a matrix."""
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    if len(left) == len(right) == 1:
        overlap = np.array([[np.isin(left[0], right[0], assume_unique=True).sum()]])
    else:
        tokens = np.intersect1d(np.concatenate(left), np.concatenate(right))
        overlap = np.zeros((len(left), len(right)))
        for low in range(0, len(tokens), 1 << 14):  # a bounded block of tokens at a time
            block = tokens[low : low + (1 << 14)]
            has = []
            for side in (left, right):
                grid = np.zeros((len(side), len(block)), np.float32)
                for i, s in enumerate(side):
                    own = s[np.searchsorted(s, block[0]) : np.searchsorted(s, block[-1], "right")]
                    at = np.searchsorted(block, own)
                    grid[i, at[block[at] == own]] = 1
                has.append(grid)
            overlap += has[0] @ has[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - overlap
    return (100 * overlap >= percent * union) & (union > 0)


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that give the components of a 0/1 matrix between two lists of ids."""
    a, b = np.arange(len(left)), np.arange(len(right)) + len(left)
    big = len(left) + len(right)
    while True:
        low = np.minimum(np.where(linked, b[None, :], big).min(1, initial=big), a)
        high = np.minimum(np.where(linked, low[:, None], big).min(0, initial=big), b)
        if (low == a).all() and (high == b).all():
            break
        a, b = low, high
    ids = np.concatenate([left, right])
    for label, own in ((a, left), (b, right)):
        for i in np.flatnonzero(ids[label] != own):
            yield int(own[i]), int(ids[label[i]])


def _compare(rows: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` found in groups of ``(task, unit, k, set)``; a task holds several units, all of a unit is compared."""

    def run(table: pa.Table) -> pa.Table:
        unit, key = table["unit"].to_numpy(), table["k"].to_numpy()
        order = np.lexsort((key, unit))
        sets = table["set"]
        found: list[tuple[int, int]] = []
        for own in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
            part = [np.frombuffer(sets[int(i)].as_py(), np.uint64) for i in own]
            found.extend(_forest(similar(part, part, percent), key[own], key[own]))
        return _links(found)

    return rows.select("task", "unit", "k", "set").groupBy("task").applyInArrow(run, "a bigint, b bigint")


def _links(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _compare_leaves(rows: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` between components, in groups of ``(task, unit, leaf, against, k, part, set)``.

    A unit holds the documents of some leaves under two nodes; ``against`` are the leaves that
    a leaf is compared with.  Pairs of leaves that links found before have joined are passed over.
    """

    def run(table: pa.Table) -> pa.Table:
        unit, leaf, key, part = (table[c].to_numpy() for c in ("unit", "leaf", "k", "part"))
        sets, against = table["set"], table["against"]
        order = np.lexsort((key, leaf, unit))
        found: list[tuple[int, int]] = []
        for own in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
            leaves = {int(leaf[x[0]]): x for x in np.split(own, np.flatnonzero(np.diff(leaf[own])) + 1)}
            names, spot = np.unique(part[own], return_inverse=True)
            place = dict(zip(own.tolist(), spot.tolist(), strict=True))
            root = np.arange(len(names))  # of each component, after the links of this unit
            for a, left in leaves.items():
                for b in sorted(set(against[int(left[0])].as_py() or ())):
                    right = leaves[b]
                    at = [np.array([place[int(i)] for i in side]) for side in (left, right)]
                    apart = root[at[0]][:, None] != root[at[1]][None, :]
                    if not apart.any():
                        continue
                    lists = [[np.frombuffer(sets[int(i)].as_py(), np.uint64) for i in side] for side in (left, right)]
                    for i, j in np.argwhere(similar(*lists, percent) & apart):
                        one, other = root[at[0][i]], root[at[1][j]]
                        if one != other:
                            root[root == other] = one
                            found.append((int(key[left[i]]), int(key[right[j]])))
        return _links(found)

    return rows.select("task", "unit", "leaf", "against", "k", "part", "set").groupBy("task").applyInArrow(run, "a bigint, b bigint")


_NODE = "level int, node bigint, low bigint, high bigint, least_n bigint, most_n bigint, slack array<bigint>, sig binary"


def _grow(table: pa.Table, level: int) -> pa.Table:
    """Nodes of ``LEVELS`` levels, the lowest of them ``level``, over one aligned range of children."""
    order = np.argsort(table["node"].to_numpy())
    number, low, high, least, most = (table[c].to_numpy()[order] for c in ("node", "low", "high", "least_n", "most_n"))
    slack = np.array(table["slack"].to_pylist(), np.int64).reshape(-1, WIDTHS)[order]
    sigs = [np.frombuffer(table["sig"][int(i)].as_py(), np.uint8) for i in order]
    out: list[list] = []
    for k in range(level, level + LEVELS):
        parent = number >> (FANOUT_BITS if k else NODE_BITS)
        edges = np.flatnonzero(np.diff(parent, prepend=parent[0] - 1))
        merged = []
        for first, last in zip(edges, [*edges[1:], len(parent)], strict=True):
            narrow = min(len(x) for x in sigs[first:last])
            total = np.zeros(narrow, np.uint8)
            for x in sigs[first:last]:
                while len(x) > narrow:
                    x = fold(x)
                total |= x
            merged.append(total)
        number, sigs = parent[edges], merged
        low, least = np.minimum.reduceat(low, edges), np.minimum.reduceat(least, edges)
        high, most = np.maximum.reduceat(high, edges), np.maximum.reduceat(most, edges)
        slack = np.maximum.reduceat(slack, edges, axis=0)
        out += [[k, *x] for x in zip(number.tolist(), low.tolist(), high.tolist(), least.tolist(), most.tolist(), slack.tolist(), [x.tobytes() for x in sigs], strict=True)]
    kinds = [pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.binary()]
    names = [x.split(" ")[0] for x in _NODE.split(", ")]
    return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _hierarchy(docs: DataFrame, top: int) -> DataFrame:
    """Nodes ``_NODE`` of the levels 0 to ``top`` or more over documents in order of ``rank``."""
    children = docs.select(F.col("rank").alias("node"), F.col("part").alias("low"), F.col("part").alias("high"), F.col("n").alias("least_n"), F.col("n").alias("most_n"), "slack", "sig")

    def grow(lowest: int):
        return lambda table: _grow(table, lowest)

    parts, level = [], 0
    while level <= top:
        shift = (FANOUT_BITS if level else NODE_BITS) + FANOUT_BITS * (LEVELS - 1)
        block = F.shiftright("node", shift).alias("block")
        grown = children.select("*", block).groupBy("block").applyInArrow(grow(level), _NODE)
        parts.append(stage(grown, "nodes"))
        level += LEVELS
        children = parts[-1].where(F.col("level") == level - 1).drop("level")
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionAll(part)
    return nodes


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` of nodes ``(a, b)`` that can still hold a link between two components."""
    for side in "ab":
        columns = [F.col(c).alias(f"{side}_{c}") for c in nodes.columns if c not in ("level", "node")]
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *columns).hint("merge"), side)
    pairs = pairs.where(~((F.col("a_low") == F.col("b_low")) & (F.col("a_high") == F.col("b_high")) & (F.col("a_low") == F.col("a_high"))))
    # sizes alone rule out many
    pairs = pairs.where(F.least("a_most_n", "b_most_n") * (100 + percent) >= (F.col("a_least_n") + F.col("b_least_n")) * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 1024):
                batch = whole.slice(first, 1024)
                sigs = [batch[f"{side}_sig"] for side in "ab"]
                sizes = np.array([[len(x.as_buffer()) for x in column] for column in sigs]).reshape(2, -1)
                slack = [np.array(batch[f"{side}_slack"].to_pylist(), np.int64).reshape(-1, WIDTHS) for side in "ab"]
                n = {c: batch[c].to_numpy() for c in ("a_least_n", "a_most_n", "b_least_n", "b_most_n")}
                keep = np.zeros(len(batch), bool)
                for own in np.unique(sizes, axis=1).T:
                    at = np.flatnonzero((sizes == own[:, None]).all(0))
                    wide = [np.stack([np.frombuffer(column[int(i)].as_buffer(), np.uint8) for i in at]) for column in sigs]
                    for k in (0, 1):
                        while wide[k].shape[1] > min(own):
                            wide[k] = fold(wide[k])
                    common = np.bitwise_count(wide[0] & wide[1]).sum(1, dtype=np.int64)
                    w = int(min(own) * 8).bit_length() - 1 - BITS
                    most = np.minimum(np.minimum(slack[0][at, w], slack[1][at, w]) + common, np.minimum(n["a_most_n"][at], n["b_most_n"][at]))
                    keep[at] = most * (100 + percent) >= (n["a_least_n"][at] + n["b_least_n"][at]) * percent
                yield batch.filter(pa.array(keep)).select(["token", "a", "b"])

    return pairs.mapInArrow(giving_back(run), "token bigint, a bigint, b bigint")


def _ranked(docs: DataFrame, order: list[str]) -> DataFrame:
    """``docs`` with ``rank``, their place in the order; ranges are counted, no task sees more than one."""
    laid = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    laid = stage(laid.withColumn("range", F.shiftright("at", 33)), "ordered")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy("range").agg(F.count("*").alias("size"), F.min("at").alias("first"))  # a row per range
    sizes = sizes.select("range", "first", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return laid.join(sizes, "range").withColumn("rank", F.col("offset") + F.col("at") - F.col("first")).drop("range", "at", "first", "offset")


def _apart(left: DataFrame, spots: DataFrame, on: list[str]) -> DataFrame:
    """``(token, a, b)``: nodes of ``left`` joined with ``spots``, without pairs whose holders of the token are one component.

    Such pairs have no link left to find; a cluster of near copies would make the square of its nodes.
    """
    right = spots.select(*on, F.col("node").alias("b"), "first", "last")
    both = left.join(right.hint("merge"), on)
    return both.where("a <= b and least(a_first, first) < greatest(a_last, last)").select("token", "a", "b")


def _merged(spots: DataFrame) -> DataFrame:
    """``spots`` in which tokens of nearly the same leaves are one token, held wherever one of them is.

    The shingles of a group of near copies, each of which some copies lack, would open every pair
    of the group's nodes once each.  Tokens with the same least leaf in hash order and like numbers
    of leaves are merged if that makes no more pairs than they make one by one.
    """
    token, kin = Window.partitionBy("token"), Window.partitionBy("kin")
    sized = spots.withColumn("n", F.count("*").over(token)).withColumn("lowest", F.min(F.xxhash64("node")).over(token))
    own = F.struct("token", "first", "last")
    joint = sized.groupBy(F.xxhash64("lowest", F.length(F.bin("n"))).alias("kin"), "node").agg(
        F.min("token").alias("token"), F.min("first").alias("first"), F.max("last").alias("last"), F.collect_list(own).alias("own"), F.sum("n").alias("alone")
    )
    # each token has n rows, so the sum of n over its rows is the square of its leaves
    joint = joint.withColumn("together", F.pow(F.count("*").over(kin), 2)).withColumn("alone", F.sum("alone").over(kin)).withColumn("least", F.min("token").over(kin))
    one = F.struct(F.col("least").alias("token"), "first", "last")
    held = F.explode(F.when(F.col("together") <= F.col("alone"), F.array(one)).otherwise(F.col("own"))).alias("held")
    return joint.select("node", held).select("held.token", "node", "held.first", "held.last")


def _open_pairs(spots: DataFrame, nodes_to, percent: int) -> DataFrame:
    """Pairs of leaves ``(a, b)`` that hold a common token and can hold a link between components.

    ``spots`` has the leaves ``(token, node, first, last)`` of each token, with the range of the
    components of the documents that hold it there; ``nodes_to(level)`` gives the nodes up to a level.
    """
    many = (F.count("*").over(Window.partitionBy("token")) > FANOUT).alias("many")
    levels = [stage(spots.select("*", many), "spots")]
    while True:
        above = levels[-1].where("many")
        if not above.limit(1).count():
            break
        up = above.groupBy("token", F.shiftright("node", FANOUT_BITS).alias("node")).agg(F.min("first").alias("first"), F.max("last").alias("last"))
        levels.append(stage(up.select("*", many), "spots"))
    nodes = nodes_to(len(levels) - 1)
    pairs = None
    for level in range(len(levels) - 1, -1, -1):
        own = levels[level].where("not many")
        both = _apart(own.select("token", F.col("node").alias("a"), F.col("first").alias("a_first"), F.col("last").alias("a_last")), own, ["token"])
        if pairs is not None:
            below = levels[level].withColumn("up", F.shiftright("node", FANOUT_BITS))
            a = below.select("token", F.col("up").alias("up_a"), F.col("node").alias("a"), F.col("first").alias("a_first"), F.col("last").alias("a_last"))
            down = pairs.select("token", F.col("a").alias("up_a"), F.col("b").alias("up")).join(a.hint("merge"), ["token", "up_a"])
            both = both.unionAll(_apart(down, below, ["token", "up"]))
        if level == 0:  # the same two leaves are compared once, whatever they share
            both = both.groupBy("a", "b").agg(F.min("token").alias("token"))
        pairs = stage(_possible(both.select("token", "a", "b"), nodes.where(F.col("level") == level), percent), "pairs")
    return pairs.select("a", "b")


def _weight() -> F.Column:
    """Documents' share of a task's memory, in sets of 512 shingles."""
    return F.greatest(F.col("n"), F.lit(512)) / 512


def _packed(units: DataFrame) -> DataFrame:
    """Units dealt to tasks of some ``LEAF`` sets each."""
    total = units.agg(F.sum(_weight())).first()[0] or 0
    return units.withColumn("task", F.pmod(F.xxhash64("unit"), F.lit(int(total) // LEAF + 1)))


def _tree_links(sets: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Links among documents with sets, given the rare tokens ``(k, token, df)`` of each."""
    same = ["k", "n", "least"]
    # near copies mostly agree in their smallest or in their largest shingle
    kind = F.explode(F.array(F.xxhash64(F.lit(0), "least"), F.xxhash64(F.lit(1), "most")))
    kinds = sets.select(*same, kind.alias("kind"))
    sizes = stage(kinds.groupBy("kind").agg(F.count("*").alias("size"), F.sum(_weight()).alias("weight")).where("size > 1"), "kinds")
    several = kinds.join(sizes.hint("merge"), "kind").withColumn("part", F.pmod(F.xxhash64("k"), F.ceil(F.col("weight") / LEAF)))
    several = several.withColumn("shift", F.explode(F.array(F.lit(0), F.lit(-1)))).where("shift = 0 or part > 0")
    several = stage(several.select(*same, F.xxhash64("kind", F.col("part") + F.col("shift")).alias("unit")), "several")
    near = sets.select(*same, "set").join(_packed(several).hint("merge"), same)
    links = stage(_compare(near, percent), "near-links")

    known = connected_components(links).select(F.col("id").alias("k"), F.col("component").alias("part"))
    parts = sets.select(*same, "slack", "sig").join(known.hint("merge"), "k", "left").withColumn("part", F.coalesce("part", "k"))
    large = known.groupBy("part").agg(F.count("*").alias("size")).where(F.col("size") >= 1 << NODE_BITS).select("part", F.col("part").alias("cluster"))
    hottest = tokens.groupBy("k").agg(F.max(F.struct("df", "token"))["token"].alias("segment"))
    docs = parts.join(large.hint("merge"), "part", "left").join(hottest.hint("merge"), "k")
    docs = stage(_ranked(docs, ["segment", "cluster", "n", "least", "k"]), "documents").withColumn("leaf", F.shiftright("rank", NODE_BITS))

    held = tokens.join(docs.select("k", "leaf", "part").hint("merge"), "k").groupBy("token", "leaf")
    held = stage(held.agg(F.min("part").alias("first"), F.max("part").alias("last")), "held")
    seen = F.xxhash64("leaf", "first", "last")
    content = [F.count("*").alias("n"), F.sum(seen.cast("decimal(38,0)")).alias("total"), F.bit_xor(seen).alias("odd")]
    open_ = held.groupBy("token").agg(F.min("first").alias("first"), F.max("last").alias("last"), *content).where("first < last")
    # shingles of one passage have the same leaves and components there: one stands for all of them
    open_ = open_.groupBy("n", "total", "odd").agg(F.min("token").alias("token")).select("token")
    spots = held.join(open_.hint("merge"), "token", "left_semi").select("token", F.col("leaf").alias("node"), "first", "last")
    pairs = _open_pairs(_merged(spots), lambda top: _hierarchy(docs, top), percent)

    unit = F.xxhash64(F.shiftright("a", FANOUT_BITS), F.shiftright("b", FANOUT_BITS)).alias("unit")
    ends = pairs.select(unit, "a", F.explode(F.array_distinct(F.array("a", "b"))).alias("leaf"), "b")
    ends = ends.groupBy("unit", "leaf").agg(F.collect_set(F.when(F.col("leaf") == F.col("a"), F.col("b"))).alias("against"))
    rest = _packed(stage(ends.join(docs.select("leaf", "part", *same).hint("merge"), "leaf"), "ends"))
    rest = sets.select(*same, "set").join(rest.hint("merge"), same)
    return links.unionAll(_compare_leaves(rest, percent))


def link_documents(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_shingles, component)`` per row: components of documents that are near copies.

    Words are runs without ASCII white space, with A-Z lower-cased; a document's set holds its
    distinct shingles of ``width`` words.  Documents link when ``100 * intersection >=
    percent * union``; ``component`` is the smallest key reachable.  Documents without words
    link with nothing.  Rows that share a key are one document for the links of either.  A
    null key counts as the smallest and is returned as null.  The key is an integer.
    """
    counted = int(min(1.0, (100 - percent) / 100 * 5 / 3) * (1 << 63)) * 2
    counted = min(counted, (1 << 63) - 1)
    rows = docs.select(whole_key(F.col(key)).alias("k"), F.col(text).alias("t"))
    sketches = stage(_sketch(rows, width, percent, counted), "sketches")
    reps = sketches.where("n > 0").groupBy("digest").agg(
        F.min("k").alias("rep"), F.any_value("n").alias("n"), F.any_value("counted").alias("counted"), F.any_value("tokens").alias("tokens")
    )
    reps = stage(reps, "representatives")
    prefix = stage(_prefix(reps, percent, counted), "prefix")
    shared = prefix.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    tokens = stage(prefix.join(shared.hint("merge"), "token").select(F.col("rep").alias("k"), "token", "df"), "rare-tokens")
    members = stage(tokens.select("k").distinct(), "members")
    sets = stage(_candidate_sets(rows, members, width), "sets")
    found = connected_components(_tree_links(sets, tokens, percent))
    names = reps.select("digest", "rep").join(found.hint("merge"), reps.rep == found.id, "left")
    names = names.select("digest", F.coalesce("component", "rep").alias("component"))
    result = sketches.select("k", "n", "digest").join(names.hint("merge"), "digest", "left")

    return result.select(
        shown_key(F.col("k")).alias(key), F.col("n").alias("n_shingles"), shown_key(F.coalesce("component", "k")).alias("component")
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that have the smallest key of their component, all columns unchanged."""
    found = link_documents(docs, width, percent, text, key)
    losers = stage(found.where(~F.col(key).eqNullSafe(F.col("component"))).select(F.col(key).cast("bigint").alias("k")).distinct(), "losers")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), whole_key(F.col(key)).alias("k"))
    keyed = may_match(keyed, "k", losers, "near")
    kept = keyed.where("near").join(losers, "k", "left_anti").select("row").unionAll(keyed.where("not near").select("row"))
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
