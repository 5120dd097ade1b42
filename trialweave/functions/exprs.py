"""Scalar column expressions; all compile to JVM-side code."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions: Sequence[Column]) -> Column:
    return functools.reduce(operator.or_, conditions)


def flag(condition: Column) -> Column:
    """0/1 integer; an unknown condition counts as 0."""
    return F.when(condition, 1).otherwise(0).cast("int")


def any_positive(*cols: Column | str) -> Column:
    """True when at least one of several nullable numbers is above zero; never NULL."""
    return any_of([F.coalesce(as_col(c), F.lit(0)) > 0 for c in cols])


def either_flag(*cols: Column | str) -> Column:
    """True when at least one nullable 0/1 column is 1; never NULL."""
    return any_of([F.coalesce(as_col(c), F.lit(0)) == 1 for c in cols])


def active_or_mode(active: Column | str, mode: Column | str) -> Column:
    """A device row that shows treatment: switched on, or with a mode recorded."""
    return either_flag(active) | as_col(mode).isNotNull()


def code_match(version: Column | str, code: Column | str, codes: Mapping[int, Sequence[str]]) -> Column:
    """Code lists that depend on the coding version."""
    return any_of([(as_col(version) == v) & as_col(code).isin(*listed) for v, listed in codes.items()])


def guarded_ratio(numerator: Column | str, denominator: Column | str, scale: float = 1.0) -> Column:
    """Ratio, NULL unless both sides are present and the denominator is positive.

    ``scale`` multiplies the denominator, for inputs stored in percent (0.01).
    """
    den = as_col(denominator) * scale if scale != 1.0 else as_col(denominator)
    return F.when(den > 0, as_col(numerator) / den)


def rate_per_weight(total: Column | str, weight: Column | str, hours: float) -> Column:
    """Amount per weight and hour, NULL when the weight is missing or not positive."""
    w = as_col(weight)
    return F.when(w > 0, as_col(total) / w / float(hours))


def plus_hours(ts: Column | str, hours: Column | int) -> Column:
    h = F.lit(hours) if isinstance(hours, int) else hours
    return as_col(ts) + F.make_dt_interval(F.lit(0), h, F.lit(0), F.lit(0))


def plus_days(ts: Column | str, days: int) -> Column:
    return plus_hours(ts, 24 * days)


def micros_between(start: Column | str, end: Column | str) -> Column:
    """Whole microseconds from ``start`` to ``end``."""
    return F.timestamp_diff("MICROSECOND", as_col(start), as_col(end))


def days_between(start: Column | str, end: Column | str) -> Column:
    return micros_between(start, end) / F.lit(float(DAY_US))


def floor_div(x: Column, n: int) -> Column:
    """Integer division rounding down, exact for negative numbers too."""
    return ((x - F.pmod(x, F.lit(n))) / F.lit(n)).cast("long")


def clamp(x: Column | str, lo: Column | float | None = None, hi: Column | float | None = None) -> Column:
    """Clamp that is NULL as soon as any input is NULL (``least``/``greatest`` skip NULLs)."""
    value = as_col(x)
    known = value.isNotNull()
    out = value
    for bound, pick in ((lo, F.greatest), (hi, F.least)):
        if bound is None:
            continue
        b = bound if isinstance(bound, Column) else F.lit(bound)
        known = known & b.isNotNull()
        out = pick(out, b)
    return F.when(known, out)


def band(x: Column | str, cuts: Sequence[float], labels: Sequence[str], missing: str = "missing") -> Column:
    """Label half-open intervals whose lower bound is inclusive; NULL gets ``missing``."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("need one label more than cut points")
    value = as_col(x)
    out = F.when(value.isNull(), F.lit(missing))
    for cut, label in zip(cuts, labels):
        out = out.when(value < cut, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def driven_by(first: Column | str, second: Column | str, labels: Sequence[str], top: int = 3) -> Column:
    """Which of two stage components reached ``top``: (first only, second only, both, neither)."""
    only_first, only_second, both, neither = labels
    a = F.coalesce(as_col(first), F.lit(0)) == top
    b = F.coalesce(as_col(second), F.lit(0)) == top
    return (
        F.when(a & b, both).when(a, only_first).when(b, only_second).otherwise(neither)
    )


def composite_key(*cols: Column | str, sep: str = "_") -> Column:
    return F.concat_ws(sep, *[as_col(c).cast("string") for c in cols])


def strip_prefix(c: Column | str, sep: str = "=") -> Column:
    """Drop everything up to and including the last ``sep`` of a label such as ``arm=A``."""
    return F.regexp_replace(as_col(c), f"^.*{sep}", "")
