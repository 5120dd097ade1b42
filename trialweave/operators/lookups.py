"""As-of and interval lookups, at one time per unit or at the end of every hour slice.

A lookup says which event rows count and how they combine.  ``gather`` and
``gather_slices`` evaluate any number of lookups together: each event table is scanned and
joined to the units once, the surviving rows of all tables are stacked, and one aggregation
by unit (or unit and slice) produces every column.  No lookup needs an inequality join, a
sort over a whole unit or a join per column.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.functions.exprs import (
    HOUR_US,
    as_col,
    floor_div,
    micros_between,
    plus_hours,
)
from trialweave.operators.joins import spread_join

#: Rows of the hour grid that one task aggregates.
GRID_ROWS = 1 << 17

# Names that the unit side brings into the join with an event table.
LO, AT, UNIT = "__lo", "__at", "__unit"


@dataclass(frozen=True)
class Lookup:
    """One event table and how its rows turn into output columns.

    Either ``value`` is computed per event row, ``combine`` merges values (max, min or sum) and
    ``outputs`` maps column names to functions of the merged value; or ``order`` ranks the rows
    and ``fields`` are those of the highest one.
    """

    events: DataFrame
    key: str
    value: Column | None = None
    combine: str = "max"
    outputs: Mapping[str, object] = field(default_factory=dict)
    order: Column | None = None
    fields: Mapping[str, Column] = field(default_factory=dict)
    # Point events carry one time; intervals carry a start and a nullable end.
    time: str | None = None
    span: tuple[str, str] | None = None
    # Window length in hours up to the reference time; None looks back without bound.
    window: float | None = None
    # "window": (t - w, t]; "after": [t, ...); "ahead": (t, t + w]; "valid": interval contains t;
    # "from": [lower bound column, t].
    side: str = "window"
    lower: Column | None = None
    where: Column | None = None
    needs: tuple[str, ...] = field(default=())

    def parts(self, i: int) -> dict[str, Column]:
        """What an event row of the ``i``-th lookup contributes, all of fixed width."""
        if self.order is None:
            return {f"__v{i}": self.value}
        return {f"__o{i}": self.order, **{f"__v{i}_{j}": c for j, c in enumerate(self.fields.values())}}

    def merged(self, i: int) -> list[Column]:
        """Aggregates of these parts, under the same names."""
        if self.order is None:
            return [{"max": F.max, "min": F.min, "sum": F.sum}[self.combine](f"__v{i}").alias(f"__v{i}")]
        chosen = [F.max_by(f"__v{i}_{j}", f"__o{i}").alias(f"__v{i}_{j}") for j in range(len(self.fields))]
        return [*chosen, F.max(f"__o{i}").alias(f"__o{i}")]

    def finished(self, i: int) -> list[Column]:
        """The output columns, from the merged parts."""
        if self.order is None:
            return [read(F.col(f"__v{i}")).alias(name) for name, read in self.outputs.items()]
        return [F.col(f"__v{i}_{j}").alias(name) for j, name in enumerate(self.fields)]

    def columns(self) -> list[str]:
        times = [self.time] if self.time else list(self.span or ())
        return list(dict.fromkeys([self.key, *times, *self.needs]))

    def matches(self) -> Column:
        """Which joined rows count, relative to the reference time of their unit."""
        at = F.col(AT)
        if self.time is not None:
            t = F.col(self.time)
            if self.side == "after":
                return t >= at
            if self.side == "ahead":
                return (t > at) & (t <= plus_hours(at, int(self.window)))
            if self.side == "from":
                return (t >= F.col(LO)) & (t <= at)
            if self.window is None:
                return t <= at
            return (t > plus_hours(at, -int(self.window))) & (t <= at)
        start, end = (F.col(c) for c in self.span)
        if self.side == "valid":
            return (start <= at) & (F.coalesce(end, at) >= at)
        return (start < at) & (F.coalesce(end, at) > plus_hours(at, -int(self.window)))


def _names(cols: Mapping[str, str] | Sequence[str] | str) -> dict[str, str]:
    """Output name -> event column."""
    if isinstance(cols, str):
        return {cols: cols}
    if isinstance(cols, Mapping):
        return dict(cols)
    return {c: c for c in cols}


# Digits of a tie-break in an order key, and the microseconds no time reaches.
_TIE, NEVER = 10**20, 10**18 - 1


def order_key(events: DataFrame, micros: Column, tiebreak: Sequence[str], fields: Sequence[Column]) -> Column:
    """A time in microseconds and a tie-break as one whole number of 38 digits.

    Keys of fixed width let Spark merge rows in hash aggregates; a struct would be sorted.
    One whole-number column can break ties this way.  Without a tie-break a hash of the
    fields does, so that a task that is run again chooses the same row.  Other tie-breaks make
    a struct.
    """
    if not tiebreak:
        tie = F.xxhash64(*fields)
    elif len(tiebreak) == 1 and isinstance(events.schema[tiebreak[0]].dataType, T.IntegralType):
        tie = F.coalesce(F.col(tiebreak[0]).cast("bigint"), F.lit(-(1 << 63)))
    else:
        return F.struct(micros.alias("o"), *tiebreak)
    wide = F.lit(Decimal(_TIE)).cast(T.DecimalType(21, 0))
    return (micros.cast(T.DecimalType(18, 0)) * wide + (tie.cast(T.DecimalType(20, 0)) + F.lit(Decimal(1 << 63)))).cast(T.DecimalType(38, 0))


def time_micros(time: str) -> Column:
    return micros_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time)


def last(
    events: DataFrame,
    key: str,
    time: str,
    cols: Mapping[str, str] | Sequence[str] | str,
    window: float | None = None,
    not_null: str | None = None,
    tiebreak: Sequence[str] = (),
    side: str = "window",
) -> Lookup:
    """Newest row at or before t, taken whole: a NULL in that row stays NULL.

    With ``not_null`` only rows holding that column compete.  Rows at the same time are
    ordered by ``tiebreak``, larger last.
    """
    names = _names(cols)
    fields = {out: F.col(src) for out, src in names.items()}
    order = order_key(events, time_micros(time), tiebreak, list(fields.values()))
    where = F.col(time).isNotNull()
    if not_null:
        where = where & F.col(not_null).isNotNull()
    needs = (*names.values(), *tiebreak, *((not_null,) if not_null else ()))
    return Lookup(events, key, order=order, fields=fields, time=time, window=window, side=side, where=where, needs=needs)


def last_ahead(events, key, time, cols, window, not_null=None, tiebreak=()) -> Lookup:
    """Newest row in ``(t, t + window]``."""
    return last(events, key, time, cols, window, not_null, tiebreak, side="ahead")


def first_time(
    events: DataFrame, key: str, time: str, name: str, where: Column | None = None, needs: Sequence[str] = ()
) -> Lookup:
    """Time of the first event at or after t."""
    return Lookup(
        events, key, F.col(time), "min", {name: lambda v: v}, time=time, side="after", where=where, needs=tuple(needs)
    )


def window_value(
    events: DataFrame,
    key: str,
    time: str,
    col: str,
    name: str,
    how: str = "sum",
    window: float | None = None,
    lower: Column | str | None = None,
    empty: float | None = None,
) -> Lookup:
    """Sum, minimum or maximum of a column over ``(t - window, t]`` or ``[lower, t]``.

    ``empty`` is the result where no row qualifies: None keeps NULL, 0 fills.
    """
    def finish(v: Column) -> Column:
        return v if empty is None else F.coalesce(v, F.lit(empty))

    side = "from" if lower is not None else "window"
    return Lookup(
        events,
        key,
        F.col(col),
        how,
        {name: finish},
        time=time,
        window=window,
        side=side,
        lower=as_col(lower) if lower is not None else None,
        where=F.col(col).isNotNull(),
        needs=(col,),
    )


def overlaps(
    intervals: DataFrame,
    key: str,
    start: str,
    end: str,
    name: str,
    window: float,
    where: Column | None = None,
    needs: Sequence[str] = (),
) -> Lookup:
    """1 when an interval meets ``(t - window, t)``, both bounds strict, open ends ongoing."""
    return Lookup(
        intervals,
        key,
        F.lit(1),
        "max",
        {name: lambda v: F.coalesce(v, F.lit(0)).cast("int")},
        span=(start, end),
        window=window,
        where=where,
        needs=tuple(needs),
    )


def overlap_value(intervals, key, start, end, col, name, window, how="max") -> Lookup:
    """Maximum (or minimum, sum) of a column over the intervals that meet the window."""
    return Lookup(
        intervals, key, F.col(col), how, {name: lambda v: v}, span=(start, end), window=window,
        where=F.col(col).isNotNull(), needs=(col,),
    )


def overlap_last(
    intervals, key, start, end, cols, window, not_null=None, tiebreak=(), open_first: bool = True
) -> Lookup:
    """Newest overlapping interval by end time; an open interval is newest if ``open_first``."""
    names = _names(cols)
    fields = {out: F.col(src) for out, src in names.items()}
    ends = F.coalesce(time_micros(end), F.lit(NEVER if open_first else -NEVER))
    order = order_key(intervals, ends, tiebreak, list(fields.values()))
    return Lookup(
        intervals, key, order=order, fields=fields, span=(start, end), window=window,
        where=F.col(not_null).isNotNull() if not_null else None,
        needs=(*names.values(), *tiebreak, *((not_null,) if not_null else ())),
    )


def valid_at(intervals, key, start, end, cols, not_null=None, tiebreak=()) -> Lookup:
    """Interval that contains t (closed ends, NULL end = still valid); latest start wins."""
    names = _names(cols)
    fields = {out: F.col(src) for out, src in names.items()}
    order = order_key(intervals, time_micros(start), tiebreak, list(fields.values()))
    return Lookup(
        intervals, key, order=order, fields=fields, span=(start, end), side="valid",
        where=F.col(not_null).isNotNull() if not_null else None,
        needs=(*names.values(), *tiebreak, *((not_null,) if not_null else ())),
    )


Span = tuple[Column, Column]


def time_span(units: DataFrame, at: str) -> Span:
    """The earliest and latest reference time as constants, found now; ``units`` should be a stage.

    Constants reach the scans of the event tables, and there prune partitions by time.
    """
    first, last_ = units.agg(F.min(at).cast("string"), F.max(at).cast("string")).first()
    kind = units.schema[at].dataType
    return F.lit(first).cast(kind), F.lit(last_).cast(kind)


def reachable(lookup: Lookup, span: Span, n: int = 0) -> Column:
    """The condition on event times alone that the window of any unit within ``span`` implies.

    ``n`` is the number of hour slices after the reference time.
    """
    first, final = span
    late = F.col(lookup.time or lookup.span[0])
    early = F.col(lookup.time or lookup.span[1])
    tests = []
    if lookup.side == "ahead":
        tests.append(late <= plus_hours(final, int(lookup.window)))
    elif lookup.side != "after":
        tests.append(late <= plus_hours(final, n))
    if lookup.side in ("after", "ahead", "valid"):
        tests.append(early >= first)
    elif lookup.side == "window" and lookup.window is not None:
        tests.append(early >= plus_hours(first, -math.ceil(lookup.window)))
    if lookup.span:
        tests[1:] = [test | early.isNull() for test in tests[1:]]
    return reduce(operator.and_, tests)


def _joined(units: DataFrame, unit: str, at: str, lookup: Lookup, span: Span | None, n: int = 0) -> DataFrame:
    """Event rows of one lookup next to the unit they belong to and its reference time.

    A row without a time, or an interval without a start, belongs to no window; a unit without a
    reference time has none.
    """
    facts = lookup.events.filter(F.col(lookup.time or lookup.span[0]).isNotNull())
    if lookup.where is not None:
        facts = facts.filter(lookup.where)
    if span is not None:
        facts = facts.filter(reachable(lookup, span, n))
    facts = facts.select(*lookup.columns())
    side = [F.col(lookup.key), F.col(unit).alias(UNIT), F.col(at).alias(AT)]
    if lookup.lower is not None:
        side.append(lookup.lower.alias(LO))
    timed = units.filter(F.col(at).isNotNull())
    return spread_join(facts, timed.select(*side), [lookup.key])


def _stacked(keys: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    for rows in parts:
        keys = keys.unionByName(rows, allowMissingColumns=True)
    return keys


def _merged(stacked: DataFrame, keys: Sequence[str], lookups: Sequence[Lookup]) -> DataFrame:
    """One row per key that has ``__copies``; a key that has several is an error.

    Only columns of fixed width are aggregated, which Spark does by hashing.
    """
    merged = [c for i, lookup in enumerate(lookups) for c in lookup.merged(i)]
    wide = stacked.groupBy(*keys).agg(F.count("__copies").alias("__copies"), *merged).filter(F.col("__copies") > 0)
    once = F.when(F.col("__copies") > 1, F.raise_error(F.lit("a unit occurs more than once")).cast("int"))
    return wide.withColumn("__copies", once)


def _reduce(base: DataFrame, unit: str, lookups: Sequence[Lookup], parts: Sequence[DataFrame]) -> DataFrame:
    """Stack the units of ``base`` and all parts, aggregate once by unit and join the rest of ``base``."""
    stacked = _stacked(base.select(unit, F.lit(1).alias("__copies")), parts)
    return base.join(_merged(stacked, [unit], lookups), unit, "inner").filter(F.col("__copies").isNull())


def _finish(lookups: Sequence[Lookup]) -> list[Column]:
    return [c for i, lookup in enumerate(lookups) for c in lookup.finished(i)]


def gather(
    units: DataFrame, unit: str, at: str, lookups: Sequence[Lookup], span: Span | None = None
) -> DataFrame:
    """``units`` plus the columns of every lookup at time ``at``; one row per ``unit`` in and out.

    ``span`` (see ``time_span``) bounds the scans of the event tables; it must cover every ``at``.
    """
    parts = []
    for i, lookup in enumerate(lookups):
        rows = _joined(units, unit, at, lookup, span).filter(lookup.matches())
        parts.append(rows.select(F.col(UNIT).alias(unit), *[c.alias(n) for n, c in lookup.parts(i).items()]))
    wide = _reduce(units, unit, lookups, parts)
    return wide.select(*units.columns, *_finish(lookups))


def hour_grid(units: DataFrame, at: str, n: int, name: str = "hour_index") -> DataFrame:
    """One row per unit and slice 0..n-1 with its start and end, generated without a join."""
    h = F.col(name)
    return (
        units.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("t_start", plus_hours(at, h))
        .withColumn("t_end", plus_hours(at, h + 1))
    )


def _slice_ends(
    units: DataFrame, unit: str, at: str, n: int, lookup: Lookup, i: int, span: Span | None
) -> DataFrame:
    """Values of one lookup with the first and last slice they count for, merged per pair of ends.

    With d the offset from the reference time in hours, a point falls in cell ceil(d) - 1
    and counts for the slices cell .. cell + w - 1.  An interval [a, b) counts for the slices
    floor(a) .. ceil(b) + w - 2, without upper end when it is open.  A unit has at most
    n * (n + 1) / 2 pairs of ends, however many events it has.
    """
    w = int(lookup.window)
    rows = _joined(units, unit, at, lookup, span, n)

    def hours_down(t: str) -> Column:
        return floor_div(micros_between(AT, t), HOUR_US)

    def hours_up(t: str) -> Column:
        return floor_div(micros_between(AT, t) + (HOUR_US - 1), HOUR_US)

    if lookup.time is not None:
        lo = hours_up(lookup.time) - 1
        hi = lo + (w - 1)
    else:
        start, end = lookup.span
        lo = hours_down(start)
        hi = F.coalesce(hours_up(end) + (w - 2), F.lit(n - 1))
    ends = (
        rows.select(
            F.col(UNIT).alias(unit),
            F.greatest(lo, F.lit(0)).cast("int").alias("__from"),
            F.least(hi, F.lit(n - 1)).cast("int").alias("__to"),
            *[c.alias(name) for name, c in lookup.parts(i).items()],
        )
        .filter(F.col("__from") <= F.col("__to"))
    )
    return ends.groupBy(unit, "__from", "__to").agg(*lookup.merged(i))


def gather_slices(
    units: DataFrame,
    unit: str,
    at: str,
    n: int,
    lookups: Sequence[Lookup],
    attributes: DataFrame | None = None,
    span: Span | None = None,
) -> DataFrame:
    """The hour grid of ``units`` plus the columns of every lookup at each slice end.

    ``attributes`` (default: ``units``) has the same units and all columns to carry along, so
    that the narrow ``units`` alone is joined to every event table.  ``span`` as in ``gather``.

    Merged rows are dealt by unit before they are repeated over slices, ``GRID_ROWS`` rows of the
    grid to a task: a task's memory depends neither on the number of units nor on how well the
    rows compress.  ``units`` is counted now and should be a stage.
    """
    for lookup in lookups:
        if lookup.window is None or lookup.window != int(lookup.window) or lookup.window < 1:
            raise ValueError("a lookup on hour slices needs a window of whole hours")
        if lookup.side != "window":
            raise ValueError("only trailing windows are defined on hour slices")
    carried = units if attributes is None else attributes
    parts = [_slice_ends(units, unit, at, n, lookup, i, span) for i, lookup in enumerate(lookups)]
    whole = units.select(unit, F.lit(0).alias("__from"), F.lit(n - 1).alias("__to"), F.lit(1).alias("__copies"))
    tasks = max(1, -(-units.count() * n // GRID_ROWS))
    dealt = _stacked(whole, parts).repartition(tasks, unit).withColumn("hour_index", F.explode(F.sequence("__from", "__to")))
    wide = carried.join(_merged(dealt, [unit, "hour_index"], lookups), unit, "inner").filter(F.col("__copies").isNull())
    h = F.col("hour_index")
    return wide.select(
        *carried.columns,
        h,
        plus_hours(at, h).alias("t_start"),
        plus_hours(at, h + 1).alias("t_end"),
        *_finish(lookups),
    )
