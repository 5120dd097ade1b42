"""A bounded broadcast filter: which rows may have a key that another table holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the bit table at most; it has 64 bits a row and is broadcast whatever the input.
FILTER_WORDS = 1 << 16
NULL_KEY = -(1 << 63)


def whole_key(column: Column) -> Column:
    """The key as a number, a null as the smallest one."""
    return F.coalesce(column.cast("bigint"), F.lit(NULL_KEY))


def shown_key(column: Column) -> Column:
    return F.when(column != NULL_KEY, column)


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def may_match(rows: DataFrame, key: str, wanted: DataFrame, name: str) -> DataFrame:
    """``rows`` with a flag that is true wherever ``wanted`` has the row's key.

    Other rows have it with the chance that the bit table is full: few while the table holds
    up to millions of keys.  A row without the flag certainly has no match and need not be
    shuffled to a join.
    """
    bits = FILTER_WORDS * 64
    spot = F.pmod(F.xxhash64(key), F.lit(bits))
    table = wanted.select(spot.alias("_spot")).groupBy(F.shiftright("_spot", 6).alias("_word"))
    table = table.agg(F.bit_or(F.expr("shiftleft(1L, cast(_spot & 63 as int))")).alias("_bits"))
    rows = rows.withColumn("_spot", spot).withColumn("_word", F.shiftright("_spot", 6))
    hit = F.expr("coalesce(shiftright(_bits, cast(_spot & 63 as int)) & 1 = 1, false)")
    return rows.join(F.broadcast(table), "_word", "left").withColumn(name, hit).drop("_word", "_spot", "_bits")
