"""Joins between a small-grain table (one row per unit) and large event tables.

One unit may own a large share of all events.  Two rules keep that off a single task:

* where only an extreme time matters, events are first reduced to one row per key, with
  map-side partial aggregation, and only those rows are joined;
* otherwise a hash of the key is one more join column.  The aggregation by unit that follows
  then needs its own exchange, so it combines on the map side first, and adaptive execution is
  free to split those partitions of the join that it measured to be too large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPREAD = "__spread"


def _key_hash(df: DataFrame, on: Sequence[str]) -> Column:
    """A hash that is equal for equal keys; whole numbers of any width count as one type."""
    whole = [isinstance(df.schema[c].dataType, T.IntegralType) for c in on]
    return F.xxhash64(*[F.col(c).cast("bigint") if w else F.col(c) for c, w in zip(on, whole)])


def spread_join(facts: DataFrame, units: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join of many fact rows to few unit rows whose hot keys may be split over tasks.

    Only the partitions that adaptive execution finds too large are split, and only they repeat
    their unit rows; no key is repeated beforehand.  The keys of both sides must have one type,
    or be whole numbers.
    """
    for c in on:
        left, right = facts.schema[c].dataType, units.schema[c].dataType
        if left != right and not (isinstance(left, T.IntegralType) and isinstance(right, T.IntegralType)):
            raise TypeError(f"{c} is {left.simpleString()} on one side and {right.simpleString()} on the other")
    hashed = [df.withColumn(_SPREAD, _key_hash(df, on)) for df in (facts, units)]
    return hashed[0].join(hashed[1], [*on, _SPREAD], "inner").drop(_SPREAD)


def require(df: DataFrame, other: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Keep rows whose key is present in ``other``."""
    names = [keys] if isinstance(keys, str) else list(keys)
    return df.join(other.select(*names).distinct(), names, "left_semi")


def exclude(df: DataFrame, other: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Keep rows whose key is absent from ``other``."""
    names = [keys] if isinstance(keys, str) else list(keys)
    return df.join(other.select(*names).distinct(), names, "left_anti")


def _earliest(events: DataFrame, key: str, time: str) -> DataFrame:
    return events.groupBy(key).agg(F.min(time).alias("__first"))


def has_event(df: DataFrame, events: DataFrame, key: str, time: str, before: str) -> DataFrame:
    """Keep rows with an event at or before column ``before``.

    An event at or before t exists exactly when the earliest one is, so no inequality join.
    """
    first = _earliest(events, key, time)
    return df.join(first, key, "inner").filter(F.col("__first") <= F.col(before)).drop("__first")


def no_event_before(df: DataFrame, events: DataFrame, key: str, time: str, before: str) -> DataFrame:
    """Keep rows without an event strictly before column ``before``."""
    first = _earliest(events, key, time)
    late_enough = F.col("__first").isNull() | F.col(before).isNull() | (F.col("__first") >= F.col(before))
    return df.join(first, key, "left").filter(late_enough).drop("__first")


def left_join(df: DataFrame, other: DataFrame, keys: str | Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Left join that brings only the named columns, so shared column names never clash."""
    names = [keys] if isinstance(keys, str) else list(keys)
    return df.join(other.select(*names, *cols), names, "left")


def clone(df: DataFrame, strategies: Sequence[str], name: str = "strategy") -> DataFrame:
    """One copy of every row per strategy, without a join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(s) for s in strategies])))


def union_labelled(parts: Sequence[tuple[Column | str, DataFrame]], label: str = "step_label") -> DataFrame:
    """Stack frames by column name, each marked with its label."""
    marked = [
        df.select((F.lit(mark) if isinstance(mark, str) else mark).alias(label), *df.columns)
        for mark, df in parts
    ]
    out = marked[0]
    for df in marked[1:]:
        out = out.unionByName(df)
    return out
