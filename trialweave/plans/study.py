"""The whole study as one configuration of the operators.

``Study`` names the inputs and parameters; its methods are the stages in dependency order.
Each stage is a function of DataFrames; ``run`` writes those that are read more than once.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.exprs import active_or_mode, any_positive, either_flag, plus_days
from trialweave.operators import censor, cohort, diagnostics, lookups, panel, survival, weights
from trialweave.operators.joins import left_join, require
from trialweave.sources.stages import materialize, stage, write_csv

# Vasoactive drugs of the shock rule, and the excluded diagnosis codes.
DRUGS = ("norepinephrine", "epinephrine", "phenylephrine", "vasopressin", "dopamine")
EXCLUDED_CODES = {10: ("N186", "Z992", "Z940"), 9: ("5856", "V451", "V420")}

# Tables read by more than one stage after the index cohort is known.
EPISODE_TABLES = ("chemistry", "bg")
EVENT_TABLES = (
    *EPISODE_TABLES, "vitalsign", "vasoactive_agent", "norepinephrine_equivalent_dose", "ventilation", "urine_output",
    "weight_durations",
)

# Output name -> source column of the baseline lookups.
VITALS = {"hr": "heart_rate", "sbp": "sbp", "dbp": "dbp", "map": "mbp", "rr": "resp_rate", "spo2": "spo2", "temp_c": "temperature"}
BLOOD_COUNT = {"wbc": "wbc", "hb": "hemoglobin", "plt": "platelet"}
CHEMISTRY = {"na": "sodium", "cl": "chloride", "k": "potassium", "hco3": "bicarbonate", "scr": "creatinine", "bun": "bun"}
ENZYMES = {"ast": "ast", "alt": "alt"}
BLOOD_GAS = {"ph": "ph", "lactate": "lactate", "pao2": "po2", "fio2": "fio2"}
COAGULATION = {"inr": "inr"}


@dataclass(frozen=True)
class Params:
    """What sensitivity analyses change."""

    rules: cohort.Eligibility = field(default_factory=lambda: cohort.Eligibility(excluded_codes=EXCLUDED_CODES))
    stage: int = 3
    lead_h: int = 6
    window_h: int = 6
    panel_h: int = 24
    grace_h: int = 24
    horizon_days: int = 28
    recovery_ratio: float = 1.5
    fio2_scale: float = 1.0
    # Stricter shock rule: lactate above this at t0.
    min_lactate: float | None = None
    # Baseline creatinine from the last days before t0 rather than since admission.
    baseline_days: int | None = None
    risk: str = "start"
    weight_mode: str = "documented"
    numerator_terms: tuple[str, ...] = weights.NUMERATOR_TERMS
    denominator_terms: tuple[str, ...] = weights.DENOMINATOR_TERMS
    ridge: float = 0.0
    as_coded_survivors: bool = False
    stop_at_censor: bool = False


@dataclass(frozen=True)
class Study:
    """Inputs by name, with the column names the operators expect, and parameters.

    Tables: units, admissions, sepsis3, weight_durations, diagnoses_icd, kdigo_stages,
    vasoactive_agent, norepinephrine_equivalent_dose, ventilation, rrt, crrt, vitalsign,
    chemistry, bg, enzyme, coagulation, complete_blood_count, charlson, sofa, urine_output.
    ``tiebreak`` names a column of the event tables that orders rows at the same time.  ``span``
    holds the first and last t0 of a study that was narrowed to its cohort.
    """

    tables: Mapping[str, DataFrame]
    params: Params = Params()
    tiebreak: tuple[str, ...] = ()
    span: lookups.Span | None = None

    def drug_given(self) -> Column:
        return any_positive(*DRUGS)

    def on_device(self) -> Column:
        return active_or_mode("system_active", "crrt_mode")

    def drug_overlap(self, name: str, window: int) -> lookups.Lookup:
        return lookups.overlaps(
            self.tables["vasoactive_agent"], "stay_id", "starttime", "endtime", name, window, self.drug_given(), DRUGS
        )

    def ventilated(self, name: str, window: int) -> lookups.Lookup:
        return lookups.overlaps(self.tables["ventilation"], "stay_id", "starttime", "endtime", name, window)

    def weight(self) -> lookups.Lookup:
        return lookups.valid_at(
            self.tables["weight_durations"], "stay_id", "starttime", "endtime", {"weight_kg": "weight"},
            not_null="weight", tiebreak=self._ties("weight_durations"),
        )

    def _ties(self, table: str) -> tuple[str, ...]:
        return tuple(c for c in self.tiebreak if c in self.tables[table].columns)

    def _last(self, table: str, key: str, cols, window: int, **kw) -> lookups.Lookup:
        time = kw.pop("time", "charttime")
        return lookups.last(self.tables[table], key, time, cols, window, tiebreak=self._ties(table), **kw)

    # --- stages -------------------------------------------------------------------------

    def core(self) -> DataFrame:
        t = self.tables
        return cohort.eligible(
            t["units"], t["admissions"], t["sepsis3"], t["weight_durations"], t["diagnoses_icd"], self.params.rules
        )

    def time_zero(self, core: DataFrame) -> DataFrame:
        return cohort.time_zero(core, self.tables["kdigo_stages"], self.params.stage, self.params.lead_h)

    def screened(self, t0: DataFrame) -> DataFrame:
        t, p = self.tables, self.params
        extra = [self._last("bg", "hadm_id", {"lactate_t0": "lactate"}, p.window_h)] if p.min_lactate is not None else []
        treatments = {
            "rrt": (t["rrt"], either_flag("dialysis_present", "dialysis_active")),
            "crrt": (t["crrt"], self.on_device()),
        }
        return cohort.screen(t0, t["sepsis3"], self.drug_overlap("drug_overlap", p.window_h), treatments, extra=extra)

    def index_cohort(self, screened: DataFrame) -> DataFrame:
        p = self.params
        strict = F.col("lactate_t0") > p.min_lactate if p.min_lactate is not None else None
        kept = cohort.index_cohort(screened, "drug_overlap", strict)
        return kept.select(*cohort.CORE_COLUMNS, "kdigo3_time", "t0_time")

    def attrition(self, core: DataFrame, screened: DataFrame) -> DataFrame:
        return cohort.attrition(core, screened, "drug_overlap")

    def baseline_lookups(self) -> list[lookups.Lookup]:
        t, w = self.tables, self.params.window_h
        dose = "norepinephrine_equivalent_dose"
        return [
            self.weight(),
            self._last("vitalsign", "stay_id", VITALS, w),
            self._last("complete_blood_count", "hadm_id", BLOOD_COUNT, w),
            self._last("chemistry", "hadm_id", CHEMISTRY, w),
            self._last("enzyme", "hadm_id", ENZYMES, w),
            self._last("bg", "hadm_id", BLOOD_GAS, w),
            self._last("coagulation", "hadm_id", COAGULATION, w),
            self.ventilated("mv_baseline", w),
            self.drug_overlap("vaso_baseline", w),
            lookups.overlap_last(
                t[dose], "stay_id", "starttime", "endtime", {"ne_eq_baseline": dose}, w, not_null=dose,
                tiebreak=self._ties(dose),
            ),
            self._last("sofa", "stay_id", {"sofa_baseline": "sofa_24hours"}, w, time="endtime", not_null="sofa_24hours"),
        ]

    def baseline(self, index: DataFrame) -> DataFrame:
        charlson = self.tables["charlson"].withColumnRenamed("charlson_comorbidity_index", "cci")
        units = index.drop("kdigo3_time")
        return panel.baseline(
            units, self.baseline_lookups(), {"cci": (charlson, "hadm_id")}, fio2_scale=self.params.fio2_scale,
            span=self.span,
        )

    def urine(self, empty: float | None = None) -> lookups.Lookup:
        return lookups.window_value(
            self.tables["urine_output"], "stay_id", "charttime", "urineoutput", "uo_total", "sum", self.params.window_h,
            empty=empty,
        )

    def subgroups(
        self, base: DataFrame, uo_stage: str = "aki_stage", creat_stage: str = "aki_stage"
    ) -> DataFrame:
        stages = self._last(
            "kdigo_stages", "stay_id", {"aki_stage_uo_t0": uo_stage, "aki_stage_creat_t0": creat_stage}, None
        )
        return panel.subgroups(base, self.urine(), stages, self.params.window_h, span=self.span)

    def panel_lookups(self) -> tuple[list[lookups.Lookup], list[lookups.Lookup]]:
        t, w = self.tables, self.params.window_h
        dose = "norepinephrine_equivalent_dose"
        at_t0 = [
            self.weight(),
            lookups.first_time(
                t["crrt"], "stay_id", "charttime", "crrt_start_time", self.on_device(), ("system_active", "crrt_mode")
            ),
        ]
        on_slices = [
            self.urine(empty=0.0),
            self._last("vitalsign", "stay_id", {"map_last1h": "mbp"}, 1, not_null="mbp"),
            self.drug_overlap("vaso_flag_last1h", 1),
            lookups.overlap_value(t[dose], "stay_id", "starttime", "endtime", dose, "ne_eq_last1h", 1),
            self.ventilated("mv_flag_last1h", 1),
            self._last("bg", "hadm_id", {"lactate_last6h": "lactate", "ph_last6h": "ph"}, w),
            self._last(
                "chemistry", "hadm_id",
                {"k_last6h": "potassium", "hco3_last6h": "bicarbonate", "scr_last6h": "creatinine"}, w,
            ),
        ]
        return at_t0, on_slices

    def hour_panel(self, index: DataFrame, hours: int | None = None) -> DataFrame:
        units = index.select("subject_id", "hadm_id", "stay_id", "t0_time")
        return self._panel(units, hours)

    def _panel(self, units: DataFrame, hours: int | None) -> DataFrame:
        p = self.params
        n = hours or p.panel_h
        if self.span is not None and n > p.panel_h:
            raise ValueError(f"the events were narrowed to {p.panel_h} hours")
        at_t0, on_slices = self.panel_lookups()
        return panel.hour_panel(units, n, at_t0, on_slices, p.window_h, span=self.span)

    def with_ends(self, index: DataFrame) -> DataFrame:
        """Units with the times that end their stay."""
        units = index.select(
            "subject_id", "hadm_id", "stay_id", "t0_time", F.col("outtime").alias("icu_outtime")
        )
        deaths = self.tables["admissions"].withColumnRenamed("deathtime", "death_time")
        return left_join(units, deaths, "hadm_id", ["death_time"])

    def clone_panel(self, index: DataFrame, hours: int | None = None) -> DataFrame:
        """Hourly panel, cloned and censored.

        Unit end and death travel with the unit through the panel, so cloning and censoring
        add no join and no shuffle.
        """
        return censor.clone_censor(self._panel(self.with_ends(index), hours), self.params.grace_h)

    def clones(self, hours: DataFrame, index: DataFrame) -> DataFrame:
        """Clones of a panel that was stored without unit end and death."""
        ends = self.with_ends(index)
        full = left_join(hours, ends, "stay_id", ["icu_outtime", "death_time"])
        return censor.clone_censor(full, self.params.grace_h)

    def outcome_lookups(self) -> tuple[lookups.Lookup, lookups.Lookup]:
        p = self.params
        labs = self.tables["chemistry"]
        lower = plus_days("t0_time", -p.baseline_days) if p.baseline_days else F.col("admittime")
        low = lookups.window_value(labs, "hadm_id", "charttime", "creatinine", "scr_baseline", "min", lower=lower)
        last = lookups.last_ahead(
            labs, "hadm_id", "charttime", {"scr_28d": "creatinine"}, 24 * p.horizon_days, "creatinine",
            self._ties("chemistry"),
        )
        return low, last

    def outcomes(self, index: DataFrame) -> DataFrame:
        low, last = self.outcome_lookups()
        return censor.outcomes(index, self.tables["admissions"], low, last, self.params.recovery_ratio, span=self.span)

    def analysis_frame(self, clones: DataFrame, base: DataFrame) -> DataFrame:
        return censor.analysis_frame(clones, base, self.params.risk)

    def weighted(self, frame: DataFrame) -> DataFrame:
        """Model-based weights; ``frame`` should be a stage, it is read once per iteration."""
        p = self.params
        terms = (p.denominator_terms, p.numerator_terms)
        den, num = weights.censor_models(frame, [weights.ModelSpec(t, ridge=p.ridge) for t in terms])
        scored = weights.predict_hazard(weights.predict_hazard(frame, den, "p_denom"), num, "p_num")
        raw = stage(weights.stabilized_weights(scored, "p_num", "p_denom", p.weight_mode), "ipcw")
        return weights.truncate_weights(raw)

    def survival_frame(self, weighted: DataFrame, outcome: DataFrame) -> DataFrame:
        """One row per clone: its last weight while uncensored, time and event."""
        p = self.params
        clones = weights.last_weight(weighted.filter(F.col("at_risk_after_k") == 1))
        cols = ["death_28d", "deathtime", "t0_time"]
        stop = None
        if p.stop_at_censor:
            ends = weighted.groupBy("stay_id", "strategy").agg(F.max("total_censor_time").alias("stop_time"))
            clones = clones.join(ends, ["stay_id", "strategy"], "left")
            stop = "stop_time"
        return censor.time_to_event(
            left_join(clones, outcome, "stay_id", cols),
            horizon=p.horizon_days, as_coded=p.as_coded_survivors, stop_at=stop,
        )

    def narrowed(self, index: DataFrame) -> Study:
        """The same study over the events of the index cohort only, each table a stage.

        Baseline, panel and outcomes read most event tables two or three times.  Keeping the
        cohort's rows once means that the full tables are scanned once, each within the times
        that a window of any unit of ``index``, a stage, can reach.
        """
        span = lookups.time_span(index, "t0_time")
        at_t0, on_slices = self.panel_lookups()
        single = [*self.baseline_lookups(), *at_t0, self.urine(), *self.outcome_lookups()]
        used = [(lookup, 0) for lookup in single] + [(lookup, self.params.panel_h) for lookup in on_slices]
        kept = {}
        for name in EVENT_TABLES:
            table = self.tables[name]
            reach = [lookups.reachable(lookup, span, n) for lookup, n in used if lookup.events is table]
            rows = table.filter(reduce(operator.or_, reach)) if reach else table
            kept[name] = stage(require(rows, index, "hadm_id" if name in EPISODE_TABLES else "stay_id"), name)
        return replace(self, tables={**self.tables, **kept}, span=span)

    # --- whole run ----------------------------------------------------------------------

    def run(self, root: str) -> StudyResult:
        """Every stage in order, each replaced under ``root``; returns scans of the stages."""
        def keep(df: DataFrame, name: str) -> DataFrame:
            return materialize(df, name, f"{root.rstrip('/')}/{name}")

        core = keep(self.core(), "core_cohort")
        t0 = keep(self.time_zero(core), "t0_cohort")
        screened = keep(self.screened(t0), "screened")
        index = keep(self.index_cohort(screened), "index_cohort")
        events = self.narrowed(index)
        base = keep(events.baseline(index), "baseline")
        groups = keep(events.subgroups(base), "subgroup_flags")
        clones = keep(events.clone_panel(index), "clone_panel")
        outcome = keep(events.outcomes(index), "outcomes")
        flow = keep(self.attrition(core, screened), "attrition")
        return StudyResult(self, core, t0, index, base, groups, clones, outcome, flow, root.rstrip("/"))


@dataclass(frozen=True)
class StudyResult:
    """Stages of one run and the analyses that start from them."""

    study: Study
    core: DataFrame
    t0: DataFrame
    index: DataFrame
    baseline: DataFrame
    subgroups: DataFrame
    clones: DataFrame
    outcomes: DataFrame
    attrition: DataFrame
    root: str

    @cached_property
    def frame(self) -> DataFrame:
        return materialize(
            self.study.analysis_frame(self.clones, self.baseline), "analysis", f"{self.root}/analysis_frame"
        )

    @cached_property
    def weighted(self) -> DataFrame:
        return materialize(self.study.weighted(self.frame), "weighted", f"{self.root}/weighted")

    @cached_property
    def survival(self) -> DataFrame:
        return materialize(
            self.study.survival_frame(self.weighted, self.outcomes), "survival", f"{self.root}/survival_frame"
        )

    @cached_property
    def curve(self) -> DataFrame:
        return materialize(
            survival.weighted_km(self.survival, weight="ipcw_trunc_last"), "curve", f"{self.root}/curve"
        )

    def risk_difference(self, step: float = 0.5) -> DataFrame:
        times = survival.time_grid(0, self.study.params.horizon_days, step)
        return survival.risk_difference(survival.km_at(self.curve, times))

    def rmst(self) -> DataFrame:
        return survival.rmst(self.curve, self.study.params.horizon_days)

    def cox(self) -> DataFrame:
        return survival.weighted_cox(self.survival, weight="ipcw_trunc_last", cluster="stay_id")

    def subgroup_cox(self, min_rows: int = 50) -> DataFrame:
        flags = list(panel.SUBGROUPS)
        rows = left_join(self.survival, self.subgroups, "stay_id", flags)
        return survival.subgroup_cox(rows, flags, min_rows, weight="ipcw_trunc_last", cluster="stay_id")

    def merged(self) -> DataFrame:
        """Clone-hours with baseline and outcomes in one frame."""
        return censor.merged_dataset(self.clones, self.baseline, self.outcomes)

    def reports(self) -> dict[str, str]:
        """Write the result tables as CSV under the run's folder; name -> path."""
        tables = {
            "cox_results": self.cox(),
            "subgroup_cox": self.subgroup_cox(),
            "weight_diagnostics": diagnostics.weight_summary(self.weighted),
            "risk_difference": self.risk_difference(),
            "rmst": self.rmst(),
        }
        paths = {name: f"{self.root}/{name}.csv" for name in (*tables, "merged_dataset")}
        for name, table in tables.items():
            write_csv(table, paths[name], single_file=True)
        write_csv(self.merged(), paths["merged_dataset"])
        return paths
