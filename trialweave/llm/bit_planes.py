"""Hard-negative mining with exact integer scores by the method of the Four Russians.

Components become integers.  Of every candidate, the bits of one weight of eight neighbouring
components are a byte: a plane per weight and group of eight.  Of every anchor, a table per
group holds the sums of all 256 subsets of its eight components.  The score is then a look-up
per byte, added over the groups and shifted by the plane's weight, the sign's plane taken off.

1. Candidates are packed into planes once and dealt into blocks of at most ``BLOCK`` rows; a
   task holds one block and the anchors pass through it, so its memory does not grow with
   either.  Only anchors are repeated, once a block.
2. First each anchor meets the rows of its own label: the best of every block are merged into
   its positives.  Then it meets the rows of other labels, and every block returns the first
   of those within the bounds that the positives' scores set; these are merged the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.sources.stages import stage

#: Candidates of one block at most; about 90 bytes each with 64 components.
BLOCK = 1 << 17
#: Rows a block has at least, as long as there are fewer blocks than tasks at a time.
LEAST_BLOCK = 1 << 10
GROUP = 8
_POSITIVES = "array<struct<place:bigint,id:bigint,score:bigint>>"


def whole_components(vector: Column, scale: int = 256) -> Column:
    """The components times ``scale`` as integers, rounded down; null where a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(F.coalesce(odd, F.lit(False)), None).otherwise(F.transform(x, lambda v: F.floor(v * scale).cast("bigint")))


def pack(x: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes of integer rows, as bytes of shape (groups, planes, rows); two's complement."""
    n, dim = x.shape
    groups = -(-dim // GROUP)
    wide = np.zeros((n, groups * GROUP), np.int64)
    wide[:, :dim] = x
    out = np.empty((groups, planes, n), np.uint8)
    for p in range(planes):
        bits = ((wide >> np.int64(p)) & 1).astype(np.uint8)
        out[:, p, :] = np.packbits(bits.reshape(n, groups, GROUP), axis=2, bitorder="little")[:, :, 0].T
    return out


def subset_sums(anchor: np.ndarray) -> np.ndarray:
    """For each group of eight components the sums of all its subsets, by the subset's byte."""
    groups = -(-len(anchor) // GROUP)
    wide = np.zeros(groups * GROUP, np.int64)
    wide[: len(anchor)] = anchor
    sums = np.zeros((groups, 1), np.int64)
    for j in range(GROUP):  # each component doubles the table
        sums = np.concatenate([sums, sums + wide.reshape(groups, GROUP)[:, j : j + 1]], axis=1)
    return sums


def scores(sums: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Exact inner products of one anchor with all packed rows."""
    groups, planes, n = packed.shape
    totals = np.zeros((planes, n), np.int64)
    for g in range(groups):
        totals += sums[g].take(packed[g])
    out = np.zeros(n, np.int64)
    for p in range(planes - 1):
        out += totals[p] << np.int64(p)
    return out - (totals[planes - 1] << np.int64(planes - 1))


def _best(score: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` highest scores, ties by smaller id."""
    if len(score) > count:
        least = np.partition(score, len(score) - count)[len(score) - count]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:count]


class _Block:
    """The candidates of one block by label, in order of id inside each."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int, planes: int) -> None:
        rows = pa.Table.from_batches(parts).combine_chunks()
        ids, label = rows["id"].to_numpy(), rows["label"].to_numpy()
        order = np.lexsort((ids, label))
        self.ids, self.label = ids[order], label[order]
        size = -(-dim // GROUP) * planes
        data = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint8).reshape(len(order), size)
        self.packed = np.ascontiguousarray(data[order].T).reshape(-1, planes, len(order))

    def bounds(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.label, label)), int(np.searchsorted(self.label, label, "right"))


def _positives(block: _Block, anchor: dict, sums: np.ndarray, count: int) -> Iterator[tuple]:
    low, high = block.bounds(anchor["label"])
    ids = block.ids[low:high]
    score = scores(sums, block.packed[:, :, low:high])
    other = np.flatnonzero(ids != anchor["id"])
    for at in other[_best(score[other], ids[other], count)]:
        yield anchor["id"], anchor["twin"], int(ids[at]), int(score[at])


def _negatives(block: _Block, anchor: dict, sums: np.ndarray, count: int, least: int, most: int) -> Iterator[tuple]:
    low, high = block.bounds(anchor["label"])
    wanted = [(p["place"], p["id"], p["score"], -(-least * p["score"] // 100), most * p["score"] // 100) for p in anchor["positives"]]
    wanted = [w for w in wanted if w[3] <= w[4]]
    if not wanted:
        return
    score = np.concatenate([scores(sums, block.packed[:, :, :low]), scores(sums, block.packed[:, :, high:])])
    ids = np.concatenate([block.ids[:low], block.ids[high:]])
    at = np.flatnonzero((score >= min(w[3] for w in wanted)) & (score <= max(w[4] for w in wanted)))
    at = at[ids[at] != anchor["id"]]
    at = at[np.lexsort((ids[at], -score[at]))]
    falling = -score[at]
    for place, key, positive, lowest, highest in wanted:
        first = int(np.searchsorted(falling, -highest))
        for x in at[first : first + count]:
            if score[x] < lowest:
                break
            yield anchor["id"], anchor["twin"], place, key, positive, int(ids[x]), int(score[x])


def _meet(candidates: DataFrame, anchors: DataFrame, blocks: int, dim: int, planes: int, found, kinds: list[tuple[str, str]]) -> DataFrame:
    """``found`` for every block and anchor; a block's candidates come before the anchors in its task."""
    left = candidates.select("block", F.lit(0).alias("kind"), "id", "label", F.lit(None).cast("bigint").alias("twin"), "bits", F.lit(None).cast("array<bigint>").alias("q"), F.lit(None).cast(_POSITIVES).alias("positives"))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    right = anchors.select(each, F.lit(1).alias("kind"), "id", "label", "twin", F.lit(None).cast("binary").alias("bits"), "q", F.col("positives").cast(_POSITIVES).alias("positives"))
    rows = left.unionAll(right).repartitionById(blocks, "block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        block, own = None, None
        for batch in batches:
            number, kind = batch["block"].to_numpy(), batch["kind"].to_numpy()
            edges = np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
            for low, high in zip([0, *edges], [*edges, len(number)], strict=True):
                piece = batch.slice(int(low), int(high - low))
                if not len(piece):
                    continue
                if number[low] != own:
                    parts, block, own = [], None, number[low]
                if kind[low] == 0:
                    parts.append(piece.select(["id", "label", "bits"]))
                    continue
                if block is None:
                    if not parts:
                        continue
                    block, parts = _Block(parts, dim, planes), []
                for at in range(0, len(piece), 64):
                    rows = []
                    for anchor in piece.slice(at, 64).select(["id", "label", "twin", "q", "positives"]).to_pylist():
                        q = np.zeros(dim, np.int64)
                        q[: len(anchor["q"])] = anchor["q"]
                        rows.extend(found(block, anchor, subset_sums(q)))
                    if rows:
                        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, [k for k, _ in kinds])

    return rows.mapInArrow(run, ", ".join(f"{k} {kind}" for k, kind in kinds))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """Hard negatives of every anchor and positive: ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components are multiplied by ``scale`` and rounded down; a score is the integer inner
    product with the anchor, higher first, ties by smaller key.  An anchor's positives are its
    first ``positives`` other rows of the same label; the negatives of each are its first
    ``negatives`` rows of other labels with ``least * positive_score <= 100 * negative_score <=
    most * positive_score``.  All rows are searched.  Rows with a null key, label or vector or
    with a component that is null or not finite take no part.  Of vectors of different lengths
    the shorter is filled up with zeros; an empty one scores zero.  A row never meets rows of
    its own key; other repeated rows are candidates one by one, and equal anchors are one.
    Scores that might not fit in 63 bits are refused.  Key and label are integers; other
    columns don't matter.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), whole_components(F.col(vector), scale).alias("q"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = stage(rows.where("id is not null and label is not null and q is not null"), "whole-vectors")
    n, dim, top = rows.agg(F.count("*"), F.max(F.size("q")), F.max(F.greatest(F.abs(F.coalesce(F.array_max("q"), F.lit(0))), F.abs(F.coalesce(F.array_min("q"), F.lit(0)))))).first()
    dim, top = max(dim or 0, 1), top or 0
    if dim * (top + 1) ** 2 >= 1 << 62:
        raise ValueError("components are too large for exact 64-bit scores")
    planes = int(top).bit_length() + 1
    wide = -(-dim // GROUP) * planes

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch["q"]
            sizes = np.diff(q.offsets.to_numpy())
            x = np.zeros((len(q), dim), np.int64)
            x[np.arange(dim)[None, :] < sizes[:, None]] = q.flatten().to_numpy()
            data = pack(x, planes).reshape(wide, len(q)).T.tobytes()
            bits = pa.array([data[k * wide : (k + 1) * wide] for k in range(len(q))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], bits], ["id", "label", "bits"])

    blocks = max(-(-n // BLOCK), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_BLOCK)), 1)
    dealt = F.pmod(F.xxhash64("id", "bits"), F.lit(blocks)).cast("int").alias("block")
    candidates = rows.select("id", "label", "q").mapInArrow(packed, "id bigint, label bigint, bits binary").select(dealt, "*")
    candidates = stage(candidates, "bit-planes")
    # a key may have several vectors, each of them an anchor
    anchors = rows.where("anchor").select("id", "label", "q", F.xxhash64("label", "q").alias("twin")).distinct()
    anchors = stage(anchors.withColumn("positives", F.array().cast(_POSITIVES)), "anchors")

    kinds = [("anchor_id", "bigint"), ("twin", "bigint"), ("positive_id", "bigint"), ("positive_score", "bigint")]
    near = _meet(candidates, anchors, blocks, dim, planes, lambda b, a, s: _positives(b, a, s, positives), kinds)
    order = Window.partitionBy("anchor_id", "twin").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    near = near.groupBy(F.col("anchor_id").alias("id"), "twin").agg(F.collect_list(F.struct(F.col("place").cast("bigint").alias("place"), F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    ready = stage(anchors.drop("positives").join(near, ["id", "twin"]), "positives")

    kinds = [*kinds[:2], ("place", "bigint"), *kinds[2:], ("negative_id", "bigint"), ("negative_score", "bigint")]
    hard = _meet(candidates, ready, blocks, dim, planes, lambda b, a, s: _negatives(b, a, s, negatives, least, most), kinds)
    order = Window.partitionBy("anchor_id", "twin", "place").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
