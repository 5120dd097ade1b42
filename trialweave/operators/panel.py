"""Baseline table, subgroup flags and hourly panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.exprs import band, driven_by, guarded_ratio, rate_per_weight
from trialweave.operators.joins import left_join
from trialweave.operators.lookups import Lookup, Span, gather, gather_slices


def baseline(
    cohort: DataFrame,
    lookups: Sequence[Lookup],
    attributes: Mapping[str, tuple[DataFrame, str]] | None = None,
    key: str = "stay_id",
    at: str = "t0_time",
    fio2_scale: float = 1.0,
    span: Span | None = None,
) -> DataFrame:
    """One row per unit with every lookup at t0 and the oxygenation ratio.

    ``attributes`` maps a column to the table (one row per key) and the key it comes from.
    ``fio2_scale`` turns the stored inspired fraction into the unit of the ratio's bands.
    """
    out = gather(cohort, key, at, lookups, span)
    for col, (table, table_key) in (attributes or {}).items():
        out = left_join(out, table, table_key, [col])
    if {"pao2", "fio2"} <= set(out.columns):
        out = out.withColumn("pf_ratio", guarded_ratio("pao2", "fio2", fio2_scale))
    return out


# Cut points and labels of the subgroup bands.
BANDS = {
    "oliguria_3grp": ("uo_mlkgph_t0_last6h", (0.3, 0.5), ("oliguria_<0.3", "oliguria_0.3-0.5", "non_oliguric_>=0.5")),
    "ne_3grp": ("ne_ugkgmin", (0.1, 0.3), ("NE_<0.1", "NE_0.1-0.3", "NE_>=0.3")),
    "lactate_2grp": ("lactate_mmol", (4.0,), ("lactate_<4", "lactate_>=4")),
    "pf_3grp": ("pf_ratio", (100.0, 200.0), ("PF_<100", "PF_100-200", "PF_>=200")),
}
PATHWAYS = ("uo_driven", "scr_driven", "mixed", "unknown")
SUBGROUPS = ("oliguria_3grp", "ne_3grp", "mv_2grp", "lactate_2grp", "pf_3grp")


def subgroups(
    base: DataFrame,
    urine: Lookup,
    stages: Lookup,
    hours: int = 6,
    key: str = "stay_id",
    at: str = "t0_time",
    span: Span | None = None,
) -> DataFrame:
    """Subgroup values and band labels at t0.

    ``base`` is the baseline table; ``urine`` must yield ``uo_total`` (NULL where no row) and
    ``stages`` must yield ``aki_stage_uo_t0`` and ``aki_stage_creat_t0``, from one stage column
    or from two.
    """
    out = gather(base, key, at, [urine, stages], span).select(
        "subject_id",
        "hadm_id",
        key,
        at,
        rate_per_weight("uo_total", "weight_kg", hours).alias("uo_mlkgph_t0_last6h"),
        F.col("ne_eq_baseline").alias("ne_ugkgmin"),
        F.coalesce("mv_baseline", F.lit(0)).cast("int").alias("mv_flag"),
        F.col("lactate").alias("lactate_mmol"),
        "pf_ratio",
        "aki_stage_uo_t0",
        "aki_stage_creat_t0",
    )
    labels: dict[str, Column] = {name: band(*spec) for name, spec in BANDS.items()}
    labels["mv_2grp"] = F.when(F.col("mv_flag") == 1, "MV").otherwise("no_MV")
    labels["aki_pathway"] = driven_by("aki_stage_uo_t0", "aki_stage_creat_t0", PATHWAYS)
    return out.withColumns(labels)


def hour_panel(
    cohort: DataFrame,
    horizon_h: int,
    at_t0: Sequence[Lookup],
    on_slices: Sequence[Lookup],
    hours: int = 6,
    key: str = "stay_id",
    at: str = "t0_time",
    span: Span | None = None,
) -> DataFrame:
    """One row per unit and hour 0..horizon-1 with the covariates known at the slice end.

    ``at_t0`` must yield ``weight_kg`` and ``crrt_start_time``; ``on_slices`` must yield
    ``uo_total`` (0 where no row), which becomes a rate per weight.
    """
    narrow = cohort.select(*dict.fromkeys([key, at, *[lookup.key for lookup in on_slices]]))
    known = gather(cohort, key, at, at_t0, span)
    wide = gather_slices(narrow, key, at, horizon_h, on_slices, known, span)
    rate = rate_per_weight("uo_total", "weight_kg", hours).alias("uo_mlkgph_last6h")
    keep = [c for c in wide.columns if c not in ("uo_total", "weight_kg")]
    return wide.select(*keep, rate)
