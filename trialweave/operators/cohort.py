"""Eligibility, time zero, index cohort and attrition counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.functions.exprs import code_match, flag, plus_hours
from trialweave.operators.joins import exclude, left_join, require
from trialweave.operators.lookups import NEVER, Lookup, gather, order_key, time_micros


def first_per_key(df: DataFrame, key: str, order: str, tiebreak: str) -> DataFrame:
    """The first row of every key by ``order`` (NULLs last), ties broken by ``tiebreak``.

    An aggregate rather than a ranking window: it combines on the map side, so a key with
    very many rows is never sorted in one task.  Rows of fixed width with a time and a whole
    number to order by are merged by hashing.
    """
    ordered = isinstance(df.schema[order].dataType, (T.TimestampNTZType, T.TimestampType))
    fixed = all(isinstance(f.dataType, _FIXED) for f in df.schema.fields)
    if ordered and fixed and isinstance(df.schema[tiebreak].dataType, T.IntegralType):
        rank = order_key(df, F.coalesce(time_micros(order), F.lit(NEVER)), [tiebreak], [])
        rest = [c for c in df.columns if c != key]
        ranked = df.select("*", rank.alias("__rank"))
        return ranked.groupBy(key).agg(*[F.min_by(c, "__rank").alias(c) for c in rest]).select(*df.columns)
    rank = F.struct(F.col(order).isNull(), F.col(order), F.col(tiebreak))
    firsts = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), rank).alias("__row"))
    return firsts.select("__row.*")


# Types that a hash aggregate can hold.
_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Eligibility:
    """Limits and code lists of the core cohort."""

    min_age: float = 18
    min_los_days: float = 1.0
    excluded_codes: Mapping[int, Sequence[str]] = field(default_factory=dict)
    code_key: str = "hadm_id"


CORE_COLUMNS = (
    "stay_id", "subject_id", "hadm_id", "intime", "outtime", "age", "gender", "race", "insurance", "los_icu",
)


def eligible(
    units: DataFrame,
    admissions: DataFrame,
    infection: DataFrame,
    weights: DataFrame,
    codes: DataFrame,
    rules: Eligibility = Eligibility(),
) -> DataFrame:
    """Core cohort: the first unit of each subject, if that unit meets every rule.

    The first unit is chosen before any other rule, so a subject whose first unit fails is
    out even if a later unit would pass.
    """
    firsts = first_per_key(units, "subject_id", "intime", "stay_id").filter(
        (F.col("age") >= rules.min_age) & (F.col("los_icu") >= rules.min_los_days)
    )
    infected = infection.filter(
        F.col("sepsis3").eqNullSafe(True) & F.col("suspected_infection_time").isNotNull()
    ).select("stay_id", "suspected_infection_time")
    timely = F.col("suspected_infection_time").between(F.col("intime"), F.col("outtime"))
    core = firsts.join(infected, "stay_id", "inner").filter(timely).drop("suspected_infection_time")
    core = require(core, weights.filter(F.col("weight").isNotNull()), "stay_id")
    if rules.excluded_codes:
        hit = codes.filter(code_match("icd_version", "icd_code", rules.excluded_codes))
        core = exclude(core, hit, rules.code_key)
    return left_join(core, admissions, "hadm_id", ["insurance"]).select(*CORE_COLUMNS)


def time_zero(
    core: DataFrame,
    stages: DataFrame,
    stage: int = 3,
    lead_hours: int = 6,
    key: str = "stay_id",
    time: str = "charttime",
    level: str = "aki_stage",
) -> DataFrame:
    """t0 = the later of entry and (first time at ``stage`` minus ``lead_hours``).

    Units that never reach the stage drop out.
    """
    reached = (
        stages.filter((F.col(level) == stage) & F.col(time).isNotNull())
        .groupBy(key)
        .agg(F.min(time).alias("kdigo3_time"))
    )
    return core.join(reached, key, "inner").withColumn(
        "t0_time", F.greatest(F.col("intime"), plus_hours("kdigo3_time", -lead_hours))
    )


def screen(
    t0: DataFrame,
    infection: DataFrame,
    drug_overlap: Lookup,
    treatments: Mapping[str, tuple[DataFrame, Column]],
    key: str = "stay_id",
    extra: Sequence[Lookup] = (),
) -> DataFrame:
    """``t0`` plus one flag per index rule, all from a single aggregation by unit.

    ``infected_by_t0``: confirmed infection at or before t0.  The flag named by
    ``drug_overlap``: an interval that meets the window before t0.  ``treated_before_t0``:
    any row of ``treatments`` (table, condition) strictly before t0.
    """
    confirmed = infection.filter(
        F.col("sepsis3").eqNullSafe(True) & F.col("suspected_infection_time").isNotNull()
    )
    out = gather(t0, key, "t0_time", [drug_overlap, *extra])
    firsts = (
        confirmed.select(key, F.col("suspected_infection_time").alias("__infected"))
        .groupBy(key).agg(F.min("__infected").alias("__infected"))
    )
    treated = [
        events.filter(shows).select(key, F.col("charttime").alias("__treated"))
        for events, shows in treatments.values()
    ]
    out = out.join(firsts, key, "left")
    if treated:
        rows = treated[0]
        for more in treated[1:]:
            rows = rows.unionByName(more)
        out = out.join(rows.groupBy(key).agg(F.min("__treated").alias("__treated")), key, "left")
        before = flag(F.col("__treated") < F.col("t0_time"))
    else:
        before = F.lit(0)
    return (
        out.withColumn("infected_by_t0", flag(F.col("__infected") <= F.col("t0_time")))
        .withColumn("treated_before_t0", before)
        .drop("__infected", "__treated")
    )


def passes(drug_flag: str) -> Column:
    return (F.col("infected_by_t0") == 1) & (F.col(drug_flag) == 1) & (F.col("treated_before_t0") == 0)


def index_cohort(
    screened: DataFrame, drug_flag: str = "drug_overlap", extra: Column | None = None
) -> DataFrame:
    """Units that meet every index rule; ``extra`` adds a stricter one, such as lactate > 2."""
    keep = passes(drug_flag) if extra is None else passes(drug_flag) & extra
    return screened.filter(keep)


# Labels of the flow table, in order.
FLOW_LABELS = (
    "101 Core cohort (adult, first ICU, LOS>=24h, sepsis3-in-ICU, weight)",
    "201 Defined t0: KDIGO stage 3 anchored (t0=KDIGO3-6h, cap at ICU intime)",
    "Dropped 101->201 (no KDIGO3 eligible for t0)",
    "301 Final cohort: sepsis<=t0 + vaso overlap (t0-6h,t0] + exclude pre-t0 RRT/CRRT",
    "Dropped 201->301 (total)",
    "Reason (201->301): Sepsis not on/before t0",
    "Reason (201->301): No vasopressor overlap in (t0-6h, t0]",
    "Reason (201->301): RRT/CRRT before t0",
)


def attrition(core: DataFrame, screened: DataFrame, drug_flag: str = "drug_overlap") -> DataFrame:
    """Eight ordered rows: stage sizes, their differences, and reasons that may overlap.

    Every reason is counted against all units with a time zero.  One pass over ``core`` and
    one over the screened units, both with map-side counts.
    """
    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(flag(condition)), F.lit(0))

    sizes = core.agg(F.count("*").alias("n101")).unionByName(
        screened.agg(
            F.count("*").alias("n201"),
            count(passes(drug_flag)).alias("n301"),
            count(F.col("infected_by_t0") == 0).alias("late"),
            count(F.col(drug_flag) == 0).alias("untreated"),
            count(F.col("treated_before_t0") == 1).alias("prior"),
        ),
        allowMissingColumns=True,
    )
    total = sizes.agg(*[F.max(c).alias(c) for c in sizes.columns])
    n101, n201, n301 = F.col("n101"), F.col("n201"), F.col("n301")
    values = (n101, n201, n101 - n201, n301, n201 - n301, F.col("late"), F.col("untreated"), F.col("prior"))
    steps = [
        F.struct(F.lit(i).alias("step_order"), F.lit(label).alias("step_label"), n.alias("n_value"))
        for i, (label, n) in enumerate(zip(FLOW_LABELS, values), start=1)
    ]
    return total.select(F.explode(F.array(*steps)).alias("s")).select("s.*")
