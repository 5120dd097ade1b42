"""Clones, artificial and administrative censoring, outcomes and the analysis frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.exprs import composite_key, days_between, flag, plus_days, plus_hours
from trialweave.operators.joins import clone, left_join
from trialweave.operators.lookups import Lookup, Span, gather

EARLY, NOT_EARLY = "A", "B"


def _between_open(t: Column, lo: Column, hi: Column) -> Column:
    return (t > lo) & (t < hi)


def clone_censor(
    panel: DataFrame,
    grace_h: int = 24,
    t0: str = "t0_time",
    treatment: str = "crrt_start_time",
    death: str = "death_time",
    out: str = "icu_outtime",
) -> DataFrame:
    """Two clones per slice with censoring times and per-slice flags.

    Arm A must start treatment before ``grace_h`` hours, arm B must not.  Deviation censors at
    the end of the grace period (A) or at treatment start (B).  Death, else leaving the unit,
    strictly inside the grace period censors administratively.  Purely row-wise: no shuffle.
    """
    g, start = F.col("grace_end"), F.col(treatment)
    early = F.coalesce(start < g, F.lit(False))
    arm_a = F.col("strategy") == EARLY
    arm_b = F.col("strategy") == NOT_EARLY
    proto, admin, total = (F.col(c) for c in ("proto_censor_time", "admin_censor_time", "total_censor_time"))
    t_end = F.col("t_end")
    return (
        clone(panel, (EARLY, NOT_EARLY))
        .withColumn("grace_end", plus_hours(t0, grace_h))
        .withColumns(
            {
                "proto_censor_time": F.when(arm_a & ~early, g).when(arm_b & early, start),
                "admin_censor_time": F.when(_between_open(F.col(death), F.col(t0), g), F.col(death)).when(
                    _between_open(F.col(out), F.col(t0), g), F.col(out)
                ),
            }
        )
        .withColumn("total_censor_time", F.least(proto, admin))
        .withColumns(
            {
                "admin_censor_driving": flag(admin.isNotNull() & (proto.isNull() | (admin <= proto))),
                "proto_censor_driving": flag(proto.isNotNull() & (admin.isNull() | (proto < admin))),
                "censor_k_total": flag((total > F.col("t_start")) & (total <= t_end)),
                "at_risk_after_k": flag(total.isNull() | (total > t_end)),
                "task_completed_within_24h": flag(arm_a & early),
                "task_maintained_no_early_24h": flag(arm_b & ~early),
            }
        )
    )


def outcomes(
    cohort: DataFrame,
    admissions: DataFrame,
    baseline_low: Lookup,
    last_value: Lookup,
    ratio: float = 1.5,
    key: str = "stay_id",
    at: str = "t0_time",
    span: Span | None = None,
) -> DataFrame:
    """Death and survival to 7 and 28 days, and recovery of the lab value at 28 days.

    ``baseline_low`` must yield ``scr_baseline`` (it may use ``admittime``) and ``last_value``
    ``scr_28d``.  Death at or before t0 gives neither death nor survival.  Missing labs give
    recovery 0.
    """
    units = cohort.select("subject_id", "hadm_id", key, at)
    # An episode without an admission row has unknown status, not survival.
    known_episodes = admissions.withColumn("__known", F.lit(1))
    units = left_join(units, known_episodes, "hadm_id", ["admittime", "deathtime", "__known"])
    out = gather(units, key, at, [baseline_low, last_value], span)
    death, t0, known = F.col("deathtime"), F.col(at), F.col("__known") == 1

    def died(days: int) -> Column:
        return F.when(known, flag((death > t0) & (death <= plus_days(at, days))))

    def lived(days: int) -> Column:
        return F.when(known, flag(death.isNull() | (death > plus_days(at, days))))

    recovered = (F.col("alive_28d") == 1) & (F.col("scr_28d") <= ratio * F.col("scr_baseline"))
    return (
        out.withColumns(
            {"death_7d": died(7), "alive_7d": lived(7), "death_28d": died(28), "alive_28d": lived(28)}
        )
        .withColumn("renal_recovery_28d_scr", flag(recovered))
        .drop("admittime", "__known")
    )


# Baseline columns of the analysis frame and their names there.
ANALYSIS_BASELINE = {
    "age": "age",
    "gender": "sex",
    "weight_kg": "weight_kg",
    "cci": "charlson_comorbidity_index",
    "ne_eq_baseline": "ne_eq_baseline",
    "mv_baseline": "mv_baseline",
    "pf_ratio": "pfratio",
    "lactate": "lactate",
    "ph": "ph",
    "scr": "scr_baseline_win",
    "k": "potassium",
}


def at_risk(risk: str = "start") -> Column:
    """Rows a censoring model is fitted on.

    ``start``: not yet censored when the slice begins, so that the slice of censoring itself
    is a row with outcome 1.  ``after``: not censored by the end of the slice, which leaves
    the outcome constantly 0; kept for comparison with results computed that way.
    """
    if risk == "after":
        return F.col("at_risk_after_k") == 1
    if risk == "start":
        total = F.col("total_censor_time")
        return total.isNull() | (total > F.col("t_start"))
    raise ValueError(f"risk must be 'start' or 'after', not {risk!r}")


def analysis_frame(
    clones: DataFrame,
    base: DataFrame,
    risk: str = "start",
    columns: Mapping[str, str] = ANALYSIS_BASELINE,
    key: str = "stay_id",
) -> DataFrame:
    """Clone-hours at risk, with renamed baseline columns and a clone id."""
    attached = base.select(key, *[F.col(c).alias(new) for c, new in columns.items()])
    return (
        clones.filter(at_risk(risk))
        .join(attached, key, "left")
        .withColumn("clone_id", composite_key(key, "strategy"))
    )


def merged_dataset(
    clones: DataFrame, base: DataFrame, outcome: DataFrame, key: str = "stay_id", taken: Sequence[str] = ()
) -> DataFrame:
    """Clones, baseline and outcomes in one frame; columns already present are not repeated."""
    have = {*clones.columns, *taken}
    base_cols = [c for c in base.columns if c not in have]
    outcome_cols = [c for c in outcome.columns if c not in have | set(base_cols)]
    return left_join(left_join(clones, base, key, base_cols), outcome, key, outcome_cols)


def time_to_event(
    df: DataFrame,
    death: str = "deathtime",
    t0: str = "t0_time",
    horizon: float = 28,
    as_coded: bool = False,
    stop_at: str | None = None,
) -> DataFrame:
    """Days from t0 to death or the horizon (``time``), and whether death came first (``event``).

    By default survivors are followed to the horizon and units dead at t0 are left out.
    ``stop_at`` names a time column that ends follow-up earlier, such as the censoring time.
    ``as_coded`` keeps every row, with NULL time for survivors and no event at or before t0.
    """
    days = days_between(t0, death)
    if as_coded:
        time = F.when(days.isNotNull(), F.least(days, F.lit(float(horizon))))
        known = df.withColumn("time", time)
        return known.withColumn("event", flag((F.col(death) > F.col(t0)) & (days <= horizon)))
    alive = df.filter(F.col(death).isNull() | (F.col(death) > F.col(t0)))
    bounds = [days, F.lit(float(horizon))]
    if stop_at:
        bounds.append(days_between(t0, stop_at))
    return alive.withColumn("time", F.least(*bounds)).withColumn("event", flag(days <= F.col("time")))


def clone_hours(
    weighted: DataFrame,
    outcome: DataFrame,
    counting: bool = False,
    weight: str = "ipcw_trunc",
    horizon: float = 28,
    panel_h: int = 24,
    as_coded: bool = False,
    key: str = "stay_id",
    arm: str = "strategy",
    order: str = "hour_index",
) -> DataFrame:
    """Every uncensored clone-hour with its own weight, as rows of a survival fit.

    Without ``counting`` each clone-hour is an observation from t0 to death or the horizon,
    the reading of the study's own scripts.  With it, hour h is at risk in (h, h + 1] hours
    only (``start``, ``time``, in days), so that a clone's weight changes over time and a
    censored clone leaves the risk set; the last hour of the panel lasts to death or the
    horizon.  An hour that begins at or after death is left out.  ``outcome`` has ``t0_time``
    and ``deathtime`` by ``key``.
    """
    hours = weighted.filter(F.col("at_risk_after_k") == 1).select(key, arm, order, weight)
    rows = left_join(hours, outcome, key, ["deathtime", "t0_time"])
    rows = time_to_event(rows, horizon=horizon, as_coded=as_coded and not counting)
    if not counting:
        return rows
    begins = F.col(order) / F.lit(24.0)
    ends = F.when(F.col(order) >= panel_h - 1, F.col("time")).otherwise(F.least((F.col(order) + 1) / F.lit(24.0), F.col("time")))
    known = rows.withColumns({"start": begins, "__end": ends}).filter(F.col("start") < F.col("time"))
    event = flag((F.col("event") == 1) & (F.col("__end") >= F.col("time")))
    return known.withColumn("event", event).withColumn("time", F.col("__end")).drop("__end")
