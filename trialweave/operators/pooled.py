"""Discrete-time outcome hazards by arm: person-periods, hazards, curves and contrasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialweave.functions.exprs import flag
from trialweave.operators.weights import censor_model, predict_hazard


def person_periods(
    df: DataFrame, periods: int, time: str = "time", event: str = "event", weight: str | None = None,
    arm: str = "strategy", keep: Sequence[str] = (),
) -> DataFrame:
    """One row per subject and day of follow-up, with 1 on the day of the event.

    Day d covers (d, d + 1]; rows stop at the last day followed, at most ``periods``.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.filter((F.col(time) > 0) & F.col(event).isNotNull()).withColumn("w", w).filter(F.col("w").isNotNull())
    last = F.least(F.ceil(time), F.lit(periods)).cast("int") - 1
    days = rows.withColumn("day", F.explode(F.sequence(F.lit(0), last)))
    died = flag((F.col(event) == 1) & (F.col(time) <= F.col("day") + 1))
    return days.select(arm, *keep, "day", "w", died.alias("died"))


def saturated_hazard(days: DataFrame, by: Sequence[str] = ("strategy", "day")) -> DataFrame:
    """Weighted share of events per cell."""
    return days.groupBy(*by).agg((F.sum(F.col("w") * F.col("died")) / F.sum("w")).alias("hazard"))


def logistic_hazard(
    days: DataFrame, weight: str = "w", arm: str = "strategy", terms: Sequence[str] = (), interaction: bool = False, ridge: float = 0.0
) -> DataFrame:
    """Hazard per arm and day from a weighted pooled logistic model with a day factor.

    Without ``terms``, person-days are merged to one weighted row per arm, day and outcome
    before the fit, and with ``interaction`` the model is saturated.  With covariate ``terms``
    the hazards are standardised: the mean over all person-days of a day, with the arm set to
    each arm in turn.
    """
    if interaction and not terms:
        return saturated_hazard(days.withColumnRenamed(weight, "w"), (arm, "day"))
    model = censor_model(days, (arm, *terms), "day", "died", weight=weight, ridge=ridge, merge=not terms)
    cells = days.select(arm, "day").distinct()
    if not terms:
        return predict_hazard(cells, model, "hazard")
    arms = F.explode(F.array(*[F.lit(a) for a in model.levels[arm]])).alias(arm)
    both = predict_hazard(days.select("day", weight, *terms, arms), model, "p").filter(F.col("p").isNotNull())
    return both.groupBy(arm, "day").agg((F.sum(F.col(weight) * F.col("p")) / F.sum(weight)).alias("hazard"))


def curve(hazard: DataFrame, arm: str = "strategy", day: str = "day") -> DataFrame:
    """Survival and cumulative incidence at the end of each day; few rows per arm."""
    along = Window.partitionBy(arm).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    surv = F.product(1 - F.col("hazard")).over(along)
    return hazard.withColumn("surv", surv).withColumn("risk", 1 - F.col("surv"))


def contrast(curves: DataFrame, tau: int, arms: tuple[str, str] = ("A", "B"), arm: str = "strategy") -> DataFrame:
    """Risk difference and difference in mean time lost at ``tau`` days, first arm minus second.

    Survival is a step per day: 1 during day 0, then the value at the end of the day before.
    """
    inside = curves.filter(F.col("day") < tau)
    per_arm = inside.groupBy(arm).agg(
        F.max_by("risk", "day").alias("risk"),
        (tau - 1 - F.sum(F.when(F.col("day") < tau - 1, F.col("surv")).otherwise(0.0))).alias("rmtl"),
    )
    wide = per_arm.groupBy().pivot(arm, list(arms)).agg(F.first("risk").alias("risk"), F.first("rmtl").alias("rmtl"))
    a, b = arms
    return wide.select(
        (F.col(f"{a}_risk") - F.col(f"{b}_risk")).alias("risk_difference"),
        (F.col(f"{a}_rmtl") - F.col(f"{b}_rmtl")).alias("rmtl_difference"),
        F.lit(f"{a} - {b}").alias("arm_contrast"),
    )
