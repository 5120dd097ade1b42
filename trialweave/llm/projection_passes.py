"""Near duplicates among vectors by sorted projection passes.

Each pass draws its own random hyperplanes; the signs of a vector's projections, concatenated,
are its sort key.  Within a label, vectors are ordered by that key and each one is compared
with the ``window`` that follow it; verified pairs of all passes are united into components.
Inside a component every pair is then compared in blocks, so the numbers of links do not
depend on the windows.  Equal vectors are one representative throughout.

A pair of cosine ``c`` shares each sign with the chance ``1 - arccos(c) / pi``; a pass finds it
when the shared leading signs leave no more than ``window`` vectors between the two.  Among
``n`` vectors spread evenly these are about ``log2(n / window)`` signs, so the number of passes
grows with the largest label: enough that a pair just at the threshold is found with the
chance ``recall``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.components import connected_components
from trialweave.sources.stages import stage

BITS = 60
#: Rows of one comparison block.
BLOCK = 2048
#: Passes at least, however small the labels are.
LEAST_PASSES = 8


def passes_for(n: int, window: int, least: float, recall: float) -> int:
    """Passes after which a pair of cosine ``least`` among ``n`` vectors is found with the chance ``recall``."""
    same = 1 - math.acos(min(max(least, -1), 1)) / math.pi
    one = same ** math.log2(max(n / window, 1))
    if not 0 < recall < 1 or one == 0:
        raise ValueError(f"no number of passes finds pairs of cosine {least} with the chance {recall}")
    return LEAST_PASSES if one == 1 else max(LEAST_PASSES, math.ceil(math.log(1 - recall) / math.log1p(-one)))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1 if n else 0)
    largest = np.abs(x).max(1, initial=0, keepdims=True)
    x = x / np.where(largest > 0, largest, 1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keys(x: np.ndarray, number: int) -> np.ndarray:
    """Concatenated signs of the random projections of one pass."""
    planes = np.random.default_rng([number, x.shape[1]]).standard_normal((x.shape[1], BITS))
    bits = (x @ planes) > 0
    return bits @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _passes(reps: DataFrame, passes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                sizes = np.array([len(v) for v in part["v"]])
                for size in np.unique(sizes):
                    own = part.filter(pa.array(sizes == size))
                    x = _matrix(own["v"])
                    for p in range(passes):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(x), p), pa.int32()), own["l"], pa.array(np.full(len(x), size), pa.int32()), pa.array(_keys(x, p)), own["id"], own["v"]],
                            ["pass", "l", "dim", "key", "id", "v"],
                        )

    item = reps.schema["v"].dataType.simpleString()
    label = reps.schema["l"].dataType.simpleString()
    return reps.mapInArrow(run, f"pass int, l {label}, dim int, key bigint, id bigint, v {item}")


def _window_pairs(x: np.ndarray, group: np.ndarray, window: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of verified pairs at most ``window`` apart within runs of equal groups."""
    left, right = [], []
    for gap in range(1, min(window, len(x) - 1) + 1):
        near = np.flatnonzero(group[:-gap] == group[gap:])
        near = near[np.einsum("ij,ij->i", x[near], x[near + gap]) >= least]
        left.append(near)
        right.append(near + gap)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


class _Joined:
    """Union-find of one task: says which pairs add something."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, i: int) -> int:
        while (j := self.up.get(i, i)) != i:
            self.up[i] = i = self.up.get(j, j)
        return i

    def adds(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


_FOUND = "kind int, part int, place int, pass int, dim int, id bigint, other bigint"


def _sweep(ordered: DataFrame, window: int, least: float) -> DataFrame:
    """Links found in the windows of each partition, and the rows at its two ends.

    ``kind`` 0: a link of ``id`` and ``other``; 1 and 2: the ``place``-th of the first and of
    the last ``window`` rows of partition ``part``.  Links within what the task has already
    joined are left out.
    """
    label, item = ordered.schema["l"].dataType.simpleString(), ordered.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, joined, tail, seen = TaskContext.get().partitionId(), _Joined(), None, 0

        def rows(table: pa.Table, kind: int) -> pa.RecordBatch:
            n = len(table)
            fixed = [pa.array(np.full(n, kind), pa.int32()), pa.array(np.full(n, number), pa.int32()), pa.array(np.arange(n), pa.int32())]
            columns = [*fixed, table["pass"], table["dim"], table["id"], pa.nulls(n, pa.int64()), table["l"], table["v"]]
            return pa.table(columns, names).combine_chunks().to_batches()

        names = ["kind", "part", "place", "pass", "dim", "id", "other", "l", "v"]
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                own = pa.Table.from_batches([batch.slice(low, 2048)])
                if seen < window:
                    head = own.slice(0, window - seen)
                    yield from rows(head, 1)
                seen += len(own)
                both = own if tail is None else pa.concat_tables([tail, own])
                found = list(_links(both, window, least, joined, 0 if tail is None else len(tail)))
                if found:
                    a, b = (pa.array(list(c), pa.int64()) for c in zip(*found, strict=True))
                    n = len(a)
                    zero = pa.array(np.zeros(n), pa.int32())
                    columns = [zero, zero, zero, zero, zero, a, b, pa.nulls(n, both["l"].type), pa.nulls(n, both["v"].type)]
                    yield pa.RecordBatch.from_arrays(columns, names)
                tail = both.slice(max(0, len(both) - window))
        if tail is not None:
            yield from rows(tail, 2)

    return ordered.mapInArrow(run, f"{_FOUND}, l {label}, v {item}")


def _links(rows: pa.Table, window: int, least: float, joined: _Joined, fresh: int = 0) -> Iterator[tuple[int, int]]:
    """Links among rows in order that ``joined`` lacks; pairs before ``fresh`` are known."""
    dim, ids = rows["dim"].to_numpy(), rows["id"].to_numpy()
    group = pa.compute.dictionary_encode(rows["l"].combine_chunks()).indices.to_numpy()
    group = (rows["pass"].to_numpy().astype(np.int64) << 32) + group
    for size in np.unique(dim):
        at = np.flatnonzero(dim == size)
        i, j = _window_pairs(_matrix(rows["v"].take(pa.array(at))), group[at], window, least)
        i, j = at[i], at[j]
        for a, b in zip(ids[i[j >= fresh]].tolist(), ids[j[j >= fresh]].tolist(), strict=True):
            if joined.adds(a, b):
                yield a, b


def _seams(ends: DataFrame, window: int, least: float) -> DataFrame:
    """Links across the ends of neighbouring partitions of the order."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("kind", "descending"), ("place", "ascending")])
        found = list(_links(table, window, least, _Joined()))
        return pa.table([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    seam = F.when(F.col("kind") == 2, F.col("part")).otherwise(F.col("part") - 1)
    return ends.withColumn("seam", seam).groupBy("seam").applyInArrow(run, "a bigint, b bigint")


def _degrees(members: DataFrame, least: float) -> DataFrame:
    """``(id, near)``: vectors in the own component that reach the cosine, each class counted whole."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    rows = members.join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    total = members.count()
    pack = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(total // BLOCK + 1))).otherwise(F.xxhash64("component"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    rows = rows.select(pack.alias("pack"), (F.col("blocks") == 1).alias("whole"), "component", "id", "mult", "v", own.cast("int").alias("own"), "blocks")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        component, ids, own, mult = (table[c].to_numpy() for c in ("component", "id", "own", "mult"))
        low, high = int(table["i"][0].as_py()), int(table["j"][0].as_py())
        order = np.lexsort((ids, component))
        near = np.zeros(len(ids), np.int64)
        for at in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
            x = _matrix(table["v"].take(pa.array(at)))
            a, b = np.flatnonzero(own[at] == low), np.flatnonzero(own[at] == high)
            linked = x[a] @ x[b].T >= least
            near[at[a]] += linked @ mult[at[b]]
            if low != high:
                near[at[b]] += linked.T @ mult[at[a]]
        return pa.table([pa.array(ids), pa.array(near)], ["id", "near"])

    counts = rows.groupBy("pack", "whole", "i", "j").applyInArrow(run, "id bigint, near bigint")
    return counts.groupBy("id").agg(F.sum("near").alias("near"))


def near_duplicates(
    vectors: DataFrame,
    least: float = 0.93,
    passes: int | None = None,
    window: int = 32,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    recall: float = 0.99,
) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row.

    Rows link when labels are equal and not null, lengths are equal and the cosine in double
    precision is ``least`` or more.  Vectors that are null, empty, zero or hold null or
    non-finite numbers link with nothing.  ``component_id`` is the smallest key reachable;
    ``kept`` says whether it is the row's own.  Rows that repeat a key count as one row each
    in ``n_links``.  A row with a null key links with nothing and is kept, with a null
    component.  The key is an integer.  Without ``passes`` there are as many as ``recall`` asks
    for in the label with the most different vectors.
    """
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(label).alias("l"), F.col(vector).alias("v"))
    number = F.lit(float("inf"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < number)) & F.exists("v", lambda x: x != 0)
    usable = rows.where(F.col("id").isNotNull() & F.col("l").isNotNull() & fine)
    classes = usable.groupBy("l", "v").agg(F.min("id").alias("rep"), F.count("*").alias("mult"))
    classes = stage(classes.select(F.col("rep").alias("id"), "mult", "l", "v"), "classes")
    if passes is None:
        most = classes.groupBy("l", F.size("v")).count().agg(F.max("count").alias("n")).first().n
        passes = passes_for(most or 0, window, least, recall)
    ordered = _passes(classes.select("id", "l", "v"), passes).repartitionByRange("pass", "l", "dim", "key", "id")
    ordered = ordered.sortWithinPartitions("pass", "l", "dim", "key", "id")
    swept = stage(_sweep(ordered, window, least), "sweep")
    links = swept.where("kind = 0").select(F.col("id").alias("a"), F.col("other").alias("b"))
    links = links.unionAll(_seams(swept.where("kind > 0"), window, least))
    found = connected_components(links)
    members = stage(classes.join(found, "id").select("component", "id", "mult", "v"), "members")
    near = _degrees(members, least)
    named = classes.join(found, "id", "left").join(near, "id", "left")
    named = named.select(F.col("l").alias("cl"), F.col("v").alias("cv"), F.coalesce("component", "id").alias("component"), F.coalesce("near", "mult").alias("near"))
    joined = usable.join(named, (usable.l == named.cl) & (usable.v == named.cv)).select("id", "component", (F.col("near") - 1).alias("links"))
    alone = rows.where(~F.coalesce(F.col("id").isNotNull() & F.col("l").isNotNull() & fine, F.lit(False)))
    result = joined.unionAll(alone.select("id", F.col("id").alias("component"), F.lit(0).cast("bigint")))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return result.select(F.col("id").alias(key), F.col("links").alias("n_links"), F.col("component").alias("component_id"), kept.alias("kept"))
