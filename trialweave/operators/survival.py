"""Weighted survival curves, contrasts, restricted means and Cox effects.

All estimators first collapse subjects to one row per group and distinct time, which combines
on the map side, and then work on that table with bucketed running sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trialweave.functions.exprs import DAY_US, flag
from trialweave.functions.running import running_sums
from trialweave.operators.joins import spread_join
from trialweave.sources.stages import stage

# Fixed value: the two-sided 95 % normal quantile.
Z95 = 1.959963984540054


def _ticks(time: str) -> Column:
    """Time in days as whole microseconds, the resolution of the inputs."""
    return F.round(F.col(time) * F.lit(float(DAY_US))).cast("long")


def _marks(rows: DataFrame, by: Sequence[str], entries: dict[str, Column], ends: dict[str, Column]) -> DataFrame:
    """Sums per group and time of what enters the risk set there and what ends there.

    ``rows`` have ``start`` and ``ticks``, an interval (start, ticks]; every row counts at both.
    ``entries`` are summed at the start, as ``in_...``, and both kinds at the end.
    """
    zero = F.lit(0.0)
    kinds = {**{f"in_{k}": (v, zero) for k, v in entries.items()}, **{k: (zero, v) for k, v in {**entries, **ends}.items()}}
    marks = [F.struct(F.col(at).alias("ticks"), *[v[i].cast("double").alias(k) for k, v in kinds.items()]) for i, at in enumerate(("start", "ticks"))]
    long = rows.select(*by, F.explode(F.array(*marks)).alias("m")).select(*by, "m.*")
    return long.groupBy(*by, "ticks").agg(*[F.sum(k).alias(k) for k in kinds])


def _counted(marks: DataFrame, by: Sequence[str], risk: dict[str, str]) -> DataFrame:
    """``marks`` with what is at risk at each time: entered before it, not ended before it."""
    net = marks.withColumns({f"__{out}": F.col(f"in_{c}") - F.col(c) for out, c in risk.items()})
    sums = running_sums(net, by, "ticks", {out: f"__{out}" for out in risk})
    # the running sum holds the entries at this time and lacks the ends at it
    return sums.withColumns({out: F.col(out) - F.col(f"in_{c}") + F.col(c) for out, c in risk.items()})


def weighted_km(
    df: DataFrame, time: str = "time", event: str = "event", weight: str | None = None, by: Sequence[str] = ("strategy",),
    start: str | None = None,
) -> DataFrame:
    """Weighted Kaplan-Meier curve per group: one row per distinct time.

    Rows with a missing time, event or weight do not take part.  ``n_risk`` and ``n_event``
    are weighted, ``count_risk`` and ``count_event`` are not.  ``std_err`` is the Greenwood
    standard error of the log survival and ``lower``/``upper`` its 95 % interval.
    ``drop`` is the size of the step at that time.  With ``start`` a row is at risk in
    (start, time] only, so a subject may have several rows whose weights differ; rows that
    start at or after their end take no part.
    """
    by = list(by)
    w = F.col(weight) if weight else F.lit(1.0)
    begin = [_ticks(start).alias("start")] if start else []
    rows = df.select(*by, *begin, _ticks(time).alias("ticks"), F.col(event).alias("e"), w.cast("double").alias("w"))
    rows = rows.dropna(subset=["ticks", "e", "w"])
    died = F.when(F.col("e") == 1, F.col("w")).otherwise(0.0)
    if start:
        marks = _marks(
            rows.filter(F.col("start") < F.col("ticks")), by, {"w": F.col("w"), "n": F.lit(1.0)},
            {"n_event": died, "count_event": F.col("e")},
        )
        at_risk = _counted(marks, by, {"n_risk": "w", "count_risk": "n"}).filter(F.col("n") > 0)
        counts = {c: F.round(c).cast("long") for c in ("count_risk", "count_event")}
        at_risk = at_risk.withColumns(counts).drop("in_w", "in_n")
    else:
        steps = rows.groupBy(*by, "ticks").agg(
            F.sum("w").alias("w"),
            F.sum(died).alias("n_event"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("e").cast("long")).alias("count_event"),
        )
        at_risk = running_sums(steps, by, "ticks", {"n_risk": "w", "count_risk": "n"}, descending=True)
    d, n = F.col("n_event"), F.col("n_risk")
    falls = d > 0
    # sums that differ by rounding only are equal
    survives = falls & (d < n * (1 - 1e-12))
    terms = at_risk.withColumns(
        {
            "__log": F.when(survives, F.log1p(-d / n)).otherwise(0.0),
            "__end": flag(falls & ~survives),
            "__var": F.when(survives, d / (n * (n - d))).otherwise(0.0),
        }
    )
    summed = running_sums(
        terms, by, "ticks", {"__log_sum": "__log", "__ended": "__end", "__var_sum": "__var"}
    )
    surv = F.when(F.col("__ended") > 0, 0.0).otherwise(F.exp("__log_sum"))
    before = F.when(F.col("__ended") > F.col("__end"), 0.0).otherwise(F.exp(F.col("__log_sum") - F.col("__log")))
    std = F.sqrt("__var_sum")
    return (
        summed.withColumns({"surv": surv, "drop": F.when(falls, before * d / n).otherwise(0.0), "std_err": std})
        .withColumns(
            {
                "time": F.col("ticks") / F.lit(float(DAY_US)),
                "lower": F.col("surv") * F.exp(-Z95 * F.col("std_err")),
                "upper": F.least(F.lit(1.0), F.col("surv") * F.exp(Z95 * F.col("std_err"))),
            }
        )
        .select(
            *by, "time", "ticks", "count_risk", "count_event", "n_risk", "n_event", "surv", "drop", "std_err",
            "lower", "upper",
        )
    )


def time_grid(start: float, stop: float, step: float) -> list[float]:
    return [start + i * step for i in range(int(round((stop - start) / step)) + 1)]


def km_at(
    km: DataFrame, times: Sequence[float], by: Sequence[str] = ("strategy",), extend: bool = False
) -> DataFrame:
    """Curve values at given times: right-continuous steps, 1 before the first row.

    Times after the last row of a group are left out unless ``extend``.  Each curve row is
    assigned to the first given time it reaches, so only one row per group and given time
    is left before values are carried forward.
    """
    by, times = list(by), sorted(times)
    grid = F.array(*[F.lit(float(t)) for t in times])
    slot = F.size(F.filter(grid, lambda g: g < F.col("time")))
    newest = F.max_by(F.struct("surv", "lower", "upper"), "ticks")
    marks = km.groupBy(*by, slot.alias("slot")).agg(newest.alias("v"), F.max("time").alias("last"))
    reach = marks.groupBy(*by).agg(F.max("last").alias("reach"))
    slots = reach.select(*by, "reach", F.posexplode(grid).alias("slot", "time"))
    along = Window.partitionBy(*by).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    filled = slots.join(marks.select(*by, "slot", "v"), [*by, "slot"], "left").withColumn(
        "v", F.last("v", ignorenulls=True).over(along)
    )
    one = F.lit(1.0)
    out = filled if extend else filled.filter(F.col("time") <= F.col("reach"))
    return out.select(
        *by,
        "time",
        F.coalesce("v.surv", one).alias("surv"),
        (1 - F.coalesce("v.surv", one)).alias("risk"),
        F.coalesce("v.lower", one).alias("lower"),
        F.coalesce("v.upper", one).alias("upper"),
    )


def risk_table(km: DataFrame, times: Sequence[float], by: Sequence[str] = ("strategy",)) -> DataFrame:
    """Number still at risk just before each given time, per group.

    A curve row counts for all given times up to its own; the earliest such row holds the
    number at risk.
    """
    by, times = list(by), sorted(times)
    grid = F.array(*[F.lit(float(t)) for t in times])
    reached = F.size(F.filter(grid, lambda g: g <= F.col("time")))
    marks = (
        km.withColumn("i", reached - 1)
        .filter(F.col("i") >= 0)
        .groupBy(*by, "i")
        .agg(F.min_by(F.struct("count_risk", "n_risk"), "ticks").alias("v"))
    )
    slots = km.select(*by).distinct().select(*by, F.posexplode(grid).alias("i", "time"))
    ahead = Window.partitionBy(*by).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    filled = slots.join(marks, [*by, "i"], "left").withColumn("v", F.last("v", ignorenulls=True).over(ahead))
    return filled.select(
        *by,
        "time",
        F.coalesce("v.count_risk", F.lit(0)).cast("long").alias("count_risk"),
        F.coalesce("v.n_risk", F.lit(0.0)).alias("n_risk"),
    )


def risk_difference(curve: DataFrame, arms: tuple[str, str] = ("A", "B"), arm: str = "strategy") -> DataFrame:
    """Difference in risk, first arm minus second, at every time both arms have a value."""
    first, second = arms
    wide = curve.groupBy("time").pivot(arm, list(arms)).agg(F.first("risk"))
    return wide.select(
        "time",
        (F.col(first) - F.col(second)).alias("rd"),
        F.lit(f"{first} - {second}").alias("arm_contrast"),
    )


def rmst(km: DataFrame, tau: float = 28, by: Sequence[str] = ("strategy",)) -> DataFrame:
    """Restricted mean time survived and lost up to ``tau`` per group, with standard error.

    The area under a step curve is tau minus every step's size times the time left after it,
    a plain sum; no row needs its neighbour.
    """
    by = list(by)
    inside = km.filter(F.col("time") < tau).withColumn("__dt", F.col("drop") * F.col("time"))
    sums = running_sums(inside, by, "ticks", {"__drop_sum": "drop", "__dt_sum": "__dt"})
    whole = inside.groupBy(*by).agg((F.lit(float(tau)) - F.sum(F.col("drop") * (tau - F.col("time")))).alias("rmst"))
    # Area up to t is t - t * (earlier steps) + sum(earlier step * its time).
    area = F.col("time") * (1 - F.col("__drop_sum") + F.col("drop")) + F.col("__dt_sum") - F.col("__dt")
    d, n = F.col("n_event"), F.col("n_risk")
    spread = F.when((d > 0) & (d < n), d / (n * (n - d))).otherwise(0.0)
    parts = sums.join(whole, by, "inner").select(
        *by, "rmst", (F.pow(F.col("rmst") - area, F.lit(2.0)) * spread).alias("__var")
    )
    every = km.select(*by).distinct()
    done = parts.groupBy(*by).agg(F.first("rmst").alias("rmst"), F.sqrt(F.sum("__var")).alias("rmst_se"))
    return every.join(done, by, "left").select(
        *by,
        F.coalesce("rmst", F.lit(float(tau))).alias("rmst"),
        F.coalesce("rmst_se", F.lit(0.0)).alias("rmst_se"),
        (tau - F.coalesce("rmst", F.lit(float(tau)))).alias("rmtl"),
    )


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic, with a relative error below 1e-10.

    Near the centre the power series of the distribution, from 3 on the continued fraction of
    the tail, so that very small p-values keep their digits.
    """
    x = F.abs(z)
    scale = F.exp(-x * x / 2) * math.sqrt(2 / math.pi)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(x.alias("s"), x.alias("t")),
        lambda acc, n: F.struct((acc.s + acc.t * x * x / (2 * n + 1)).alias("s"), (acc.t * x * x / (2 * n + 1)).alias("t")),
        lambda acc: acc.s,
    )
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda f, n: n / (x + f))
    return F.when(x < 3, 1 - scale * series).otherwise(scale / (x + fraction))


def rmst_contrast(table: DataFrame, arms: tuple[str, str] = ("A", "B"), arm: str = "strategy") -> DataFrame:
    """Differences and ratios of restricted means, first arm against second, with 95 % limits.

    Three rows: RMST difference, RMST ratio and RMTL ratio.  The table has one row per arm.
    """
    first, second = arms
    wide = table.groupBy().pivot(arm, list(arms)).agg(
        F.first("rmst").alias("rmst"), F.first("rmst_se").alias("se"), F.first("rmtl").alias("rmtl")
    )
    a, b = ({c: F.col(f"{x}_{c}") for c in ("rmst", "se", "rmtl")} for x in (first, second))
    diff_se = F.sqrt(a["se"] ** 2 + b["se"] ** 2)

    def additive() -> Column:
        est = a["rmst"] - b["rmst"]
        return F.struct(
            F.lit("rmst_difference").alias("contrast"), est.alias("estimate"), (est - Z95 * diff_se).alias("lower"),
            (est + Z95 * diff_se).alias("upper"), F.when(diff_se > 0, normal_p(est / diff_se)).alias("p"),
        )

    def ratio(kind: str) -> Column:
        defined = (a[kind] > 0) & (b[kind] > 0)
        log = F.when(defined, F.log(a[kind] / b[kind]))
        se = F.when(defined, F.sqrt((a["se"] / a[kind]) ** 2 + (b["se"] / b[kind]) ** 2))
        return F.struct(
            F.lit(f"{kind}_ratio").alias("contrast"), F.exp(log).alias("estimate"), F.exp(log - Z95 * se).alias("lower"),
            F.exp(log + Z95 * se).alias("upper"), F.when(se > 0, normal_p(log / se)).alias("p"),
        )

    return wide.select(F.explode(F.array(additive(), ratio("rmst"), ratio("rmtl"))).alias("r")).select("r.*")


_COX_SCHEMA = T.StructType(
    [T.StructField("__g", T.LongType()), T.StructField("__beta", T.DoubleType())]
)


# Tied events per row of the event-time table: bounds the work of one row.
_TIE_CHUNK = 4096


def _event_times(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group and event time: weighted sums at risk and of events, by arm."""
    w, x, e = F.col("w"), F.col("x"), F.col("e")
    zero = F.lit(0.0)
    if "start" in rows.columns:
        arms = {"w1": F.when(x == 1, w).otherwise(zero), "w0": F.when(x == 0, w).otherwise(zero)}
        events = {f"d{k[1]}": F.when(e == 1, v).otherwise(zero) for k, v in arms.items()}
        counted = _counted(_marks(rows, by, arms, {**events, "k": e.cast("double") * F.col("n")}), by, {"r1": "w1", "r0": "w0"})
        counted = counted.withColumns({"k": F.round("k").cast("long"), "r1": F.greatest("r1", "d1"), "r0": F.greatest("r0", "d0")})
        return counted.filter(F.col("k") > 0).drop("in_w1", "in_w0")
    steps = rows.groupBy(*by, "ticks").agg(
        F.sum(F.when(x == 1, w).otherwise(zero)).alias("w1"),
        F.sum(F.when(x == 0, w).otherwise(zero)).alias("w0"),
        F.sum(F.when((x == 1) & (e == 1), w).otherwise(zero)).alias("d1"),
        F.sum(F.when((x == 0) & (e == 1), w).otherwise(zero)).alias("d0"),
        F.sum(e.cast("long") * F.col("n")).alias("k"),
    )
    return running_sums(steps, by, "ticks", {"r1": "w1", "r0": "w0"}, descending=True).filter(F.col("k") > 0)


def _tied(times: DataFrame, by: list[str], ties: str) -> DataFrame:
    """One row per event, carrying the share of tied events already removed from the risk set.

    Very many ties at one time are first cut into chunks and spread over tasks.
    """
    if ties == "breslow":
        return times.withColumns({"share": F.lit(0.0), "m": F.col("d0") + F.col("d1")})
    chunks = times.withColumn("__from", F.explode(F.sequence(F.lit(0), F.col("k") - 1, F.lit(_TIE_CHUNK))))
    spread = chunks.repartition(*by, "ticks", "__from")
    last = F.least(F.col("__from") + (_TIE_CHUNK - 1), F.col("k") - 1)
    return spread.withColumn("__l", F.explode(F.sequence("__from", last))).withColumns(
        {"share": F.col("__l") / F.col("k"), "m": (F.col("d0") + F.col("d1")) / F.col("k")}
    )


def weighted_cox(
    df: DataFrame,
    time: str = "time",
    event: str = "event",
    arm: str = "strategy",
    weight: str | None = None,
    by: Sequence[str] = (),
    treated: str = "B",
    ties: str = "efron",
    cluster: str | None = None,
    start: str | None = None,
    count: str | None = None,
    max_groups: int = 10_000,
    max_iter: int = 30,
    tol: float = 1e-10,
) -> DataFrame:
    """Weighted proportional hazards with one binary arm, fitted for every group of ``by``.

    Returns the log hazard ratio of ``treated`` against the other arm and its model-based
    standard error, z, p and 95 % limits on both scales; with ``cluster`` also a standard
    error robust to rows of the same cluster.  With ``start`` a row is at risk in (start, time]
    only.  With ``count`` a row stands for that many rows that differ in their weight alone, and
    ``weight`` is the sum of their weights.  All groups iterate together: each Newton step is one
    aggregation of the event-time table, which is written as a stage once.  Only one number per
    group passes through the driver; more than ``max_groups`` groups are refused.  Estimates are
    NULL for a group whose fit did not converge or that has no events in one comparison.
    """
    if ties not in ("efron", "breslow"):
        raise ValueError(f"ties must be 'efron' or 'breslow', not {ties!r}")
    spark = df.sparkSession
    keys = [F.col(c) for c in by] or [F.lit("all").alias("__all")]
    names = list(by) or ["__all"]
    n = F.col(count).cast("long") if count else F.lit(1).cast("long")
    w = F.col(weight) if weight else n
    group = F.xxhash64(*[F.col(c) for c in names])
    extra = [F.col(cluster).alias("__cluster")] if cluster else []
    extra += [_ticks(start).alias("start")] if start else []
    rows = (
        df.select(*keys, *extra, _ticks(time).alias("ticks"), F.col(event).alias("e"),
                  flag(F.col(arm) == treated).alias("x"), w.cast("double").alias("w"), n.alias("n"))
        .dropna(subset=["ticks", "e", "w"])
        .filter(F.col("w") > 0)
        .withColumn("__g", group)
    )
    if start:
        rows = rows.filter(F.col("start") < F.col("ticks"))
    times = stage(_tied(_event_times(rows, ["__g"]), ["__g"], ties), "event-times")
    groups = stage(
        rows.groupBy(*names, "__g").agg(F.sum("n").alias("n"), F.sum(F.col("e").cast("long") * F.col("n")).alias("n_event")),
        "groups",
    )
    ids = [r["__g"] for r in groups.select("__g").limit(max_groups + 1).collect()]
    if len(ids) > max_groups:
        raise ValueError(f"more than {max_groups} groups; is {by} really a list of subgroup columns?")
    if len(set(ids)) != len(ids):
        raise ValueError("group identifiers collide; rename a level")
    beta = {g: 0.0 for g in ids}
    info: dict[int, float] = {}
    moving, done = set(ids), set()
    for _ in range(max_iter):
        sums = {r["__g"]: r for r in _score(spark, times, beta, moving).collect()}
        for g in list(moving):
            r = sums.get(g)
            if r is None or not r["info"] or r["info"] <= 0:
                moving.discard(g)
                continue
            step = max(-2.0, min(2.0, r["score"] / r["info"]))
            info[g] = r["info"]
            if abs(step) <= tol * (1 + abs(beta[g])):
                moving.discard(g)
                done.add(g)
            else:
                beta[g] += step
        if not moving:
            break
    fitted = spark.createDataFrame(
        [(g, beta[g] if g in done else None, info[g] if g in done else None, g in done) for g in ids],
        T.StructType([*_COX_SCHEMA.fields, T.StructField("info", T.DoubleType()), T.StructField("converged", T.BooleanType())]),
    )
    out = groups.join(F.broadcast(fitted), "__g", "inner").withColumn("se", 1 / F.sqrt("info"))
    if cluster:
        out = out.join(_robust(rows, times, fitted), "__g", "left").withColumn(
            "robust_se", F.sqrt("meat") / F.col("info")
        )
    est, se = F.col("__beta"), F.col("robust_se" if cluster else "se")
    z = est / se
    return out.select(
        *[c for c in names if c != "__all"],
        "n",
        "n_event",
        est.alias("log_hr"),
        F.exp(est).alias("hr"),
        "se",
        *(["robust_se"] if cluster else []),
        z.alias("z"),
        normal_p(z).alias("p"),
        (est - Z95 * se).alias("log_lower"),
        (est + Z95 * se).alias("log_upper"),
        F.exp(est - Z95 * se).alias("hr_lower"),
        F.exp(est + Z95 * se).alias("hr_upper"),
        "converged",
    )


def _risk_sums(theta: Column) -> tuple[Column, Column]:
    """Risk-set totals of weight x hazard: treated part and whole, net of removed ties."""
    treated = theta * (F.col("r1") - F.col("share") * F.col("d1"))
    return treated, treated + F.col("r0") - F.col("share") * F.col("d0")


def _score(spark: SparkSession, times: DataFrame, beta: dict[int, float], groups: set[int]) -> DataFrame:
    """Score and information of each group at its current coefficient."""
    current = spark.createDataFrame([(g, beta[g]) for g in sorted(groups)], _COX_SCHEMA)
    theta = F.exp("__beta")
    part, whole = _risk_sums(theta)
    mean = part / whole
    # Every row of one event time carries the same share m of its events' weight.
    observed = F.col("m") * F.col("d1") / (F.col("d0") + F.col("d1"))
    return (
        times.join(F.broadcast(current), "__g", "inner")
        .groupBy("__g")
        .agg(
            F.sum(observed - F.col("m") * mean).alias("score"),
            F.sum(F.col("m") * mean * (1 - mean)).alias("info"),
        )
    )


def _robust(rows: DataFrame, times: DataFrame, fitted: DataFrame) -> DataFrame:
    """Sum of squared cluster totals of the weighted score residuals, per group."""
    theta = F.exp("__beta")
    part, whole = _risk_sums(theta)
    mean = part / whole
    keep = 1 - F.col("share")
    per_time = (
        times.join(F.broadcast(fitted.select("__g", "__beta")), "__g", "inner")
        .groupBy("__g", "ticks")
        .agg(
            F.sum(F.col("m") / whole).alias("h"),
            F.sum(F.col("m") / whole * mean).alias("hm"),
            F.sum(keep * F.col("m") / whole).alias("h_tied"),
            F.sum(keep * F.col("m") / whole * mean).alias("hm_tied"),
            F.avg(mean).alias("mean"),
        )
    )
    # Every distinct time of the rows, so that running hazards exist for censored rows too.
    ends = rows.select("__g", "ticks")
    if "start" in rows.columns:
        ends = ends.unionAll(rows.select("__g", F.col("start").alias("ticks")))
    all_times = ends.distinct().join(per_time, ["__g", "ticks"], "left").fillna(0.0)
    hazards = running_sums(all_times, ["__g"], "ticks", {"cum_h": "h", "cum_hm": "hm"})
    hazards = hazards.join(F.broadcast(fitted.select("__g", "__beta")), "__g", "inner")
    joined = spread_join(rows, hazards, ["__g", "ticks"])
    if "start" in rows.columns:
        before = hazards.select("__g", F.col("ticks").alias("start"), F.col("cum_h").alias("start_h"), F.col("cum_hm").alias("start_hm"))
        joined = spread_join(joined, before, ["__g", "start"])
    x, e = F.col("x"), F.col("e")
    died = e == 1
    # A subject that dies among ties leaves their risk sets step by step.
    h = F.when(died, F.col("cum_h") - F.col("h") + F.col("h_tied")).otherwise(F.col("cum_h"))
    hm = F.when(died, F.col("cum_hm") - F.col("hm") + F.col("hm_tied")).otherwise(F.col("cum_hm"))
    if "start" in rows.columns:
        # a row collects hazard from its own start only
        h, hm = h - F.col("start_h"), hm - F.col("start_hm")
    observed = F.when(died, x - F.col("mean")).otherwise(0.0)
    residual = observed - F.exp(F.col("__beta") * x) * (x * h - hm)
    return (
        joined.select("__g", "__cluster", (F.col("w") * residual).alias("u"))
        .groupBy("__g", "__cluster")
        .agg(F.sum("u").alias("u"))
        .groupBy("__g")
        .agg(F.sum(F.col("u") * F.col("u")).alias("meat"))
    )


def subgroup_cox(
    df: DataFrame,
    flags: Sequence[str],
    min_rows: int = 50,
    time: str = "time",
    event: str = "event",
    arm: str = "strategy",
    weight: str | None = None,
    start: str | None = None,
    **cox,
) -> DataFrame:
    """Cox effects within every level of several flags; levels with fewer rows are skipped.

    Flags become (subgroup, level) rows, so all levels of all flags are one grouped fit.  Rows that
    differ in their weight alone are first merged into one; with ``cluster`` rows are kept, as few
    would merge.  The large levels are a stage, so that joining them does not move rows by level.
    """
    cluster = cox.get("cluster")
    ids = [time, event, arm, *(c for c in (start, cluster) if c)]
    rows = df.dropna(subset=[c for c in (time, event, weight) if c])
    if weight:
        rows = rows.filter(F.col(weight) > 0)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    if cluster:
        merged = rows.select(*ids, *flags, w.alias("__w"), F.lit(1).cast("long").alias("__n"))
    else:
        merged = stage(rows.groupBy(*ids, *flags).agg(F.sum(w).alias("__w"), F.count(F.lit(1)).alias("__n")), "merged-rows")
    long = merged.unpivot([*ids, "__w", "__n"], list(flags), "subgroup", "level").dropna(subset=["level"])
    sizes = long.groupBy("subgroup", "level").agg(F.sum("__n").alias("__rows")).filter(F.col("__rows") >= min_rows)
    large = long.join(stage(sizes.drop("__rows"), "large-levels"), ["subgroup", "level"], "left_semi")
    return weighted_cox(large, time, event, arm, "__w", by=("subgroup", "level"), start=start, count="__n", **cox)


def interaction_test(fits: DataFrame, by: str = "subgroup") -> DataFrame:
    """Whether effects differ between the levels of each subgroup (treatment x subgroup).

    Fits per level are a model with an interaction and its own baseline hazard per level;
    the Wald test of equal effects is Cochran's Q on k - 1 degrees of freedom.
    """
    usable = fits.filter(F.col("se") > 0)
    v = 1 / (F.col("se") * F.col("se"))
    sums = usable.groupBy(by).agg(
        F.count(F.lit(1)).alias("levels"),
        F.sum(v).alias("v"),
        F.sum(v * F.col("log_hr")).alias("vb"),
        F.sum(v * F.col("log_hr") * F.col("log_hr")).alias("vbb"),
    )
    q = F.greatest(F.col("vbb") - F.col("vb") * F.col("vb") / F.col("v"), F.lit(0.0))
    tested = sums.filter(F.col("levels") > 1).select(by, "levels", q.alias("q"), (F.col("levels") - 1).alias("df"))
    return tested.withColumn("p_interaction", chi_square_p(F.col("q"), F.col("df")))


def chi_square_p(q: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution for whole degrees of freedom.

    Tail(df) adds the terms (q/2)^i exp(-q/2) / gamma(i + 1) for i = df/2 - 1, df/2 - 2, ...
    down to 0 (even) or to 1/2 (odd, on top of the normal tail).
    """
    half = q / 2
    odd = df % 2 == 1
    first = F.when(odd, F.sqrt(half) * 2 / math.sqrt(math.pi)).otherwise(F.lit(1.0))
    n = F.when(odd, (df - 1) / 2).otherwise(df / 2).cast("int")
    start = F.when(odd, F.lit(1.5)).otherwise(F.lit(1.0))
    empty = F.struct(F.lit(0.0).alias("s"), first.alias("t"))
    summed = F.aggregate(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        empty,
        lambda acc, i: F.struct((acc.s + acc.t).alias("s"), (acc.t * half / (start + i)).alias("t")),
        lambda acc: acc.s,
    )
    return F.when(odd, normal_p(F.sqrt(q))).otherwise(F.lit(0.0)) + F.exp(-half) * summed
