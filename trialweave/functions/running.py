"""Running sums and exact quantiles that never sort a whole group in one task."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialweave.functions.exprs import floor_div

# Ordering values per bucket, buckets per block and levels of blocks.  In microseconds a block is
# 9.5 hours: 28 days have 71 blocks, a century 92,000.
BUCKET_WIDTH, FAN_OUT, LEVELS = 1 << 21, 1 << 14, 1


def _sums_before(
    totals: DataFrame, by: Sequence[str], bucket: str, names: Sequence[str], fan_out: int, levels: int
) -> DataFrame:
    """Per bucket, the sums over all earlier buckets of its group, under the same names.

    A tree: buckets are summed to blocks of ``fan_out``, these again to larger ones, and every
    window stays inside one block.  Only the window over the topmost blocks spans a group.
    """
    if levels == 0:
        earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*by, bucket, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in names])
    block = f"{bucket}_"
    cut = totals.withColumn(block, floor_div(F.col(bucket), fan_out))
    above = cut.groupBy(*by, block).agg(*[F.sum(c).alias(c) for c in names])
    before = _sums_before(above, by, block, names, fan_out, levels - 1)
    offsets = before.select(*by, block, *[F.col(c).alias(f"{c}_") for c in names])
    earlier = Window.partitionBy(*by, block).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.select(*by, block, bucket, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in names])
    joined = inside.join(offsets, [*by, block], "inner")
    return joined.select(*by, bucket, *[(F.col(c) + F.col(f"{c}_")).alias(c) for c in names])


def _by_buckets(
    df: DataFrame, by: Sequence[str], bucket: str, order: Column, values: Mapping[str, str], fan_out: int, levels: int
) -> DataFrame:
    """Running sums by bucket totals first, then within each bucket."""
    inside = Window.partitionBy(*by, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = [f"__o_{out}" for out in values]
    totals = df.groupBy(*by, bucket).agg(*[F.sum(src).alias(c) for c, src in zip(before, values.values())])
    offsets = _sums_before(totals, by, bucket, before, fan_out, levels)
    partial = df.withColumns({out: F.sum(src).over(inside) for out, src in values.items()})
    joined = partial.join(offsets, [*by, bucket], "inner")
    summed = joined.withColumns({out: F.col(out) + F.col(f"__o_{out}") for out in values})
    return summed.drop(bucket, *before)


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    values: Mapping[str, str],
    descending: bool = False,
    width: int = BUCKET_WIDTH,
    fan_out: int = FAN_OUT,
    levels: int = LEVELS,
) -> DataFrame:
    """Inclusive running sums along an integer column, one row per (``by``, ``order``) given.

    Values are cut into buckets of ``width`` consecutive integers, buckets into blocks of
    ``fan_out``, over ``levels`` levels.  Totals are summed from the top down, then rows within
    their bucket: a window holds at most ``width`` rows, ``fan_out`` totals, or at the top as
    many totals as the range of values has blocks, however many rows there are in the group.
    ``values`` maps output to input columns.  NULL in ``by`` or ``order`` leaves a row out.
    """
    key = -F.col(order) if descending else F.col(order)
    cut = df.withColumn("__bucket", floor_div(key, width))
    return _by_buckets(cut, by, "__bucket", key, values, fan_out, levels)


def running_counts(df: DataFrame, by: Sequence[str], value: str, count: str, out: str, buckets: int = 1000) -> DataFrame:
    """Inclusive running counts along a float column, one row per (``by``, ``value``) given.

    Bucket bounds are approximate quantiles of the values themselves, so buckets stay even
    for any distribution; ``buckets`` grows with the expected number of distinct values.
    The bounds are computed now, from ``df``, which should be a stage.
    """
    probs = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(df.approxQuantile(value, probs, 0.5 / buckets)))
    splits = [-math.inf, *bounds, math.inf]
    cut = Bucketizer(splits=splits, inputCol=value, outputCol="__bucket").transform(df)
    return _by_buckets(cut, by, "__bucket", F.col(value), {out: count}, FAN_OUT, 0)


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    small: int = 1_000_000,
    accuracy: int = 10_000,
) -> dict[tuple[str, float], float | None]:
    """Exact linearly interpolated quantiles of nullable columns, NULLs skipped.

    An exact percentile keeps every distinct value in one aggregation buffer.  While more
    than ``small`` values could hold a quantile, approximate quantiles bracket it and the
    bracket is checked by counting; the exact percentile then runs on the bracket only.
    Every step is one aggregate over ``df``, which should be a stage.
    """
    counted = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    result: dict[tuple[str, float], float | None] = {}
    open_: dict[tuple[str, float], dict] = {}
    for i, c in enumerate(cols):
        n = counted[f"n{i}"]
        for p in probs:
            if n == 0:
                result[c, p] = None
            else:
                open_[c, p] = {"pos": (n - 1) * p, "below": 0, "inside": n, "lo": None, "hi": None}

    def within(c: str, b: dict) -> Column:
        x = F.col(c)
        keep = x.isNotNull()
        if b["lo"] is not None:
            keep = keep & (x >= b["lo"])
        if b["hi"] is not None:
            keep = keep & (x <= b["hi"])
        return keep

    wide = {k for k, b in open_.items() if b["inside"] > small}
    while wide:
        keys = sorted(wide)
        guesses = []
        for j, (c, p) in enumerate(keys):
            b = open_[c, p]
            m, r = b["inside"], b["pos"] - b["below"]
            slack = 2.0 / accuracy + 2.0 / m
            ends = [max(0.0, r / m - slack), min(1.0, r / m + slack)]
            guesses.append(
                F.percentile_approx(F.when(within(c, b), F.col(c)), ends, accuracy).alias(f"g{j}")
            )
        guessed = df.agg(*guesses).first()
        checks = []
        for j, (c, p) in enumerate(keys):
            lo, hi = guessed[f"g{j}"]
            inside = within(c, open_[c, p])
            x = F.col(c)
            checks.append(F.count(F.when(inside & (x < lo), 1)).alias(f"b{j}"))
            checks.append(F.count(F.when(inside & (x >= lo) & (x <= hi), 1)).alias(f"m{j}"))
        seen = df.agg(*checks).first()
        for j, (c, p) in enumerate(keys):
            b = open_[c, p]
            lo, hi = guessed[f"g{j}"]
            below, inside = b["below"] + seen[f"b{j}"], seen[f"m{j}"]
            first, final = math.floor(b["pos"]), math.ceil(b["pos"])
            holds = below <= first and below + inside > final
            if holds and lo == hi:
                result[c, p] = float(lo)
                del open_[c, p]
                wide.discard((c, p))
                continue
            shrunk = holds and inside < b["inside"]
            if shrunk:
                b.update(below=below, inside=inside, lo=lo, hi=hi)
            if not shrunk or inside <= small:
                wide.discard((c, p))
    if open_:
        keys = sorted(open_)
        exact = []
        for j, (c, p) in enumerate(keys):
            b = open_[c, p]
            rank = 0.0 if b["inside"] == 1 else (b["pos"] - b["below"]) / (b["inside"] - 1)
            exact.append(F.percentile(F.when(within(c, b), F.col(c)), F.lit(min(1.0, max(0.0, rank)))).alias(f"e{j}"))
        found = df.agg(*exact).first()
        for j, k in enumerate(keys):
            result[k] = found[f"e{j}"]
    return result
