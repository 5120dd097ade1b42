"""Queries for cohort, panel, clone and outcome stages of the study."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.operators import censor, diagnostics, lookups
from trialweave.plans import oracle_inputs, proxies  # noqa: F401
from trialweave.plans.registry import oracle, query
from trialweave.plans.study import Study
from trialweave.sources import read_csv, shared_dir, stage, write_csv

_CORE = ["stay_id", "subject_id", "hadm_id", "gender", "race", "insurance"]
_TIMES = ["intime", "outtime", "kdigo3_time", "t0_time"]


def _start(spark: SparkSession, sf: str, **params) -> tuple[Study, DataFrame]:
    s = proxies.study(spark, sf, **params)
    return s, proxies.relaxed_cohort(s)


# --- funnel ----------------------------------------------------------------------------------

@query("eligible", oracle("SELECT * FROM core", ts=["intime", "outtime"], num=["age", "los_icu"], plain=_CORE))
def eligible(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.study(spark, sf).core()


@query("time_zero", oracle("SELECT * FROM coh", ts=["kdigo3_time", "t0_time"], plain=["stay_id"]))
def time_zero(spark: SparkSession, sf: str) -> DataFrame:
    """First stage-3 time and t0 of every unit that has one."""
    _, cohort = _start(spark, sf)
    return cohort.select("stay_id", "kdigo3_time", "t0_time")


def _index(spark: SparkSession, sf: str, **params) -> tuple[DataFrame, DataFrame, Study]:
    s = proxies.study(spark, sf, **params)
    core = stage(s.core(), "core")
    return core, stage(s.screened(stage(s.time_zero(core), "time-zero")), "screened"), s


@query("index_cohort", oracle("SELECT * FROM index_cohort", ts=_TIMES, num=["age", "los_icu"], plain=_CORE))
def index_cohort(spark: SparkSession, sf: str) -> DataFrame:
    _, screened, s = _index(spark, sf)
    return s.index_cohort(screened)


@query("index_screen", oracle("""SELECT stay_id, CAST(infected AS INTEGER) AS infected_by_t0, CAST(on_drug AS INTEGER) AS drug_overlap,
    CAST(treated AS INTEGER) AS treated_before_t0 FROM screened""", plain=["stay_id", "infected_by_t0", "drug_overlap", "treated_before_t0"]))
def index_screen(spark: SparkSession, sf: str) -> DataFrame:
    """The three index rules as flags."""
    _, screened, _ = _index(spark, sf)
    return screened.select("stay_id", "infected_by_t0", "drug_overlap", "treated_before_t0")


@query("index_cohort_strict", oracle("""SELECT i.stay_id, i.t0_time FROM screened i WHERE infected AND on_drug AND NOT treated AND (SELECT l.lactate FROM lab l WHERE l.hadm_id = i.hadm_id
    AND l.charttime > i.t0_time - INTERVAL 6 HOUR AND l.charttime <= i.t0_time ORDER BY l.charttime DESC, l.event_id DESC LIMIT 1) > 2""", ts=["t0_time"], plain=["stay_id"]))
def index_cohort_strict(spark: SparkSession, sf: str) -> DataFrame:
    """The index rules and the stricter lactate rule."""
    _, screened, s = _index(spark, sf, min_lactate=2.0)
    return s.index_cohort(screened).select("stay_id", "t0_time")


@query("lactate_screen", oracle("""SELECT i.stay_id, i.t0_time FROM screened i WHERE infected AND (SELECT l.lactate FROM lab l WHERE l.hadm_id = i.hadm_id
    AND l.charttime > i.t0_time - INTERVAL 6 HOUR AND l.charttime <= i.t0_time ORDER BY l.charttime DESC, l.event_id DESC LIMIT 1) > 2""", ts=["t0_time"], plain=["stay_id"]))
def lactate_screen(spark: SparkSession, sf: str) -> DataFrame:
    """The lactate rule with the infection rule alone, which more units meet."""
    _, screened, s = _index(spark, sf, min_lactate=2.0)
    strict = (F.col("infected_by_t0") == 1) & (F.col("lactate_t0") > s.params.min_lactate)
    return screened.filter(strict).select("stay_id", "t0_time")


@query("attrition", oracle("""SELECT CAST(step_order AS INTEGER) AS step_order, step_label, CAST(n_value AS INTEGER) AS n_value FROM (
    SELECT 1 AS step_order, '101 Core cohort (adult, first ICU, LOS>=24h, sepsis3-in-ICU, weight)' AS step_label, (SELECT count(*) FROM core) AS n_value
    UNION ALL SELECT 2, '201 Defined t0: KDIGO stage 3 anchored (t0=KDIGO3-6h, cap at ICU intime)', (SELECT count(*) FROM t_zero)
    UNION ALL SELECT 3, 'Dropped 101->201 (no KDIGO3 eligible for t0)', (SELECT count(*) FROM core) - (SELECT count(*) FROM t_zero)
    UNION ALL SELECT 4, '301 Final cohort: sepsis<=t0 + vaso overlap (t0-6h,t0] + exclude pre-t0 RRT/CRRT', (SELECT count(*) FROM index_cohort)
    UNION ALL SELECT 5, 'Dropped 201->301 (total)', (SELECT count(*) FROM t_zero) - (SELECT count(*) FROM index_cohort)
    UNION ALL SELECT 6, 'Reason (201->301): Sepsis not on/before t0', (SELECT count(*) FROM screened WHERE NOT infected)
    UNION ALL SELECT 7, 'Reason (201->301): No vasopressor overlap in (t0-6h, t0]', (SELECT count(*) FROM screened WHERE NOT on_drug)
    UNION ALL SELECT 8, 'Reason (201->301): RRT/CRRT before t0', (SELECT count(*) FROM screened WHERE treated)) q""",
    plain=["step_order", "step_label", "n_value"]))
def attrition(spark: SparkSession, sf: str) -> DataFrame:
    core, screened, s = _index(spark, sf)
    return s.attrition(core, screened)


# --- baseline and panel ----------------------------------------------------------------------

_BASE_NUM = [
    "age", "los_icu", "weight_kg", "hr", "sbp", "dbp", "map", "rr", "spo2", "temp_c", "wbc", "hb", "plt", "na", "cl", "k",
    "hco3", "scr", "bun", "ast", "alt", "ph", "lactate", "pao2", "fio2", "pf_ratio", "inr", "ne_eq_baseline",
]


@query("baseline", oracle("SELECT * FROM base", ts=["intime", "outtime", "t0_time"], num=_BASE_NUM,
       plain=[*_CORE, "cci", "mv_baseline", "vaso_baseline", "sofa_baseline"]))
def baseline(spark: SparkSession, sf: str) -> DataFrame:
    s, cohort = _start(spark, sf)
    return s.baseline(cohort)


_FLAG_TEXT = ["oliguria_3grp", "ne_3grp", "mv_2grp", "lactate_2grp", "pf_3grp", "aki_pathway"]


@query("subgroup_flags", oracle("SELECT * FROM sub_flags", ts=["t0_time"], num=["uo_mlkgph_t0_last6h", "ne_ugkgmin", "lactate_mmol", "pf_ratio"],
       plain=["subject_id", "hadm_id", "stay_id", "mv_flag", "aki_stage_uo_t0", "aki_stage_creat_t0", *_FLAG_TEXT]))
def subgroup_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Bands at t0; the pathway uses separate urine and creatinine stages."""
    s, cohort = _start(spark, sf)
    return s.subgroups(stage(s.baseline(cohort), "baseline"), creat_stage="aki_stage_creat")


@query("subgroup_flags_one_stage", oracle("""SELECT stay_id, CASE WHEN aki_stage_uo_t0 = 3 THEN 'mixed' ELSE 'unknown' END AS aki_pathway FROM sub_flags""",
       plain=["stay_id", "aki_pathway"]))
def subgroup_flags_one_stage(spark: SparkSession, sf: str) -> DataFrame:
    """Both components read from one stage column, as the study's own tables provide it."""
    s, cohort = _start(spark, sf)
    return s.subgroups(stage(s.baseline(cohort), "baseline")).select("stay_id", "aki_pathway")


_PANEL_NUM = ["uo_mlkgph_last6h", "map_last1h", "ne_eq_last1h", "lactate_last6h", "ph_last6h", "k_last6h", "hco3_last6h", "scr_last6h"]
_PANEL_PLAIN = ["subject_id", "hadm_id", "stay_id", "hour_index", "vaso_flag_last1h", "mv_flag_last1h"]
_PANEL_TS = ["t0_time", "t_start", "t_end", "crrt_start_time"]


def _panel_query(hours: int) -> None:
    @query(f"hour_panel_{hours}", oracle(f"SELECT * FROM panel_{hours}", ts=_PANEL_TS, num=_PANEL_NUM, plain=_PANEL_PLAIN))
    def hour_panel(spark: SparkSession, sf: str) -> DataFrame:
        s, cohort = _start(spark, sf)
        return s.hour_panel(cohort, hours)


for _h in (12, 24, 36):
    _panel_query(_h)


# --- clones and outcomes ---------------------------------------------------------------------

_CENSOR_TS = ["death_time", "icu_outtime", "grace_end", "proto_censor_time", "admin_censor_time", "total_censor_time"]
_CENSOR_FLAGS = [
    "admin_censor_driving", "proto_censor_driving", "censor_k_total", "at_risk_after_k", "task_completed_within_24h",
    "task_maintained_no_early_24h",
]


def bare_clones(s: Study, cohort: DataFrame, hours: int = 24) -> DataFrame:
    """Clone panel without covariates: grid, treatment start, censoring."""
    known = lookups.gather(s.with_ends(cohort), "stay_id", "t0_time", [s.panel_lookups()[0][1]])
    grid = lookups.hour_grid(known.drop("subject_id", "hadm_id"), "t0_time", hours)
    return censor.clone_censor(grid, s.params.grace_h)


_BARE_TS = ["t0_time", "t_start", "t_end", "crrt_start_time", *_CENSOR_TS]


@query("clone_censor", oracle("SELECT * FROM clone_bare", ts=_BARE_TS, plain=["stay_id", "strategy", "hour_index", *_CENSOR_FLAGS]))
def clone_censor(spark: SparkSession, sf: str) -> DataFrame:
    s, cohort = _start(spark, sf)
    return bare_clones(s, cohort)


@query("clone_censor_12h", oracle("SELECT * FROM clone_bare_12", ts=_BARE_TS, plain=["stay_id", "strategy", "hour_index", *_CENSOR_FLAGS]))
def clone_censor_12h(spark: SparkSession, sf: str) -> DataFrame:
    """Sensitivity analysis: 12 hours of grace on the 12-hour panel."""
    s, cohort = _start(spark, sf, grace_h=12)
    return bare_clones(s, cohort, 12)


@query("clone_panel", oracle("SELECT * FROM clone_full", ts=[*_PANEL_TS, *_CENSOR_TS], num=_PANEL_NUM, plain=[*_PANEL_PLAIN, "strategy", *_CENSOR_FLAGS]))
def clone_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly panel, cloned and censored."""
    s, cohort = _start(spark, sf)
    return s.clone_panel(cohort)


@query("clone_stored_panel", oracle("SELECT * FROM clone_full", ts=_CENSOR_TS, plain=["stay_id", "strategy", "hour_index", *_CENSOR_FLAGS]))
def clone_stored_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a panel that was stored without unit end and death."""
    s, cohort = _start(spark, sf)
    stored = stage(s.hour_panel(cohort), "panel")
    return s.clones(stored, cohort).select(*_CENSOR_TS, "stay_id", "strategy", "hour_index", *_CENSOR_FLAGS)


@query("censor_rate_by_hour", oracle("SELECT hour_index, avg(censor_k_total) AS censor_rate, count(*) AS n FROM clone_bare WHERE total_censor_time IS NULL OR total_censor_time > t_start GROUP BY hour_index",
       num=["censor_rate"], plain=["hour_index", "n"]))
def censor_rate_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    """Share censored per hour among clones at risk."""
    s, cohort = _start(spark, sf)
    return diagnostics.censor_rate(bare_clones(s, cohort).filter(censor.at_risk("start")))


@query("censor_rate_by_strategy", oracle("""SELECT hour_index, strategy, avg(censor_k_total) AS censor_rate, count(*) AS n FROM clone_bare
    WHERE total_censor_time IS NULL OR total_censor_time > t_start GROUP BY hour_index, strategy""", num=["censor_rate"], plain=["hour_index", "strategy", "n"]))
def censor_rate_by_strategy(spark: SparkSession, sf: str) -> DataFrame:
    """Share censored per hour and arm among clones at risk: the flagship query."""
    s, cohort = _start(spark, sf)
    return diagnostics.censor_rate(bare_clones(s, cohort).filter(censor.at_risk("start")), ["hour_index", "strategy"])


@query("outcomes", oracle("""SELECT *, CASE WHEN alive_28d = 1 AND scr_28d <= 1.5 * scr_baseline THEN 1 ELSE 0 END AS renal_recovery_28d_scr FROM outc""",
       ts=["t0_time", "deathtime"], num=["scr_baseline", "scr_28d"],
       plain=["subject_id", "hadm_id", "stay_id", "death_7d", "alive_7d", "death_28d", "alive_28d", "renal_recovery_28d_scr"]))
def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    s, cohort = _start(spark, sf)
    return s.outcomes(cohort)


@query("outcomes_7d_baseline", oracle("""SELECT stay_id, scr_baseline_7d AS scr_baseline, CASE WHEN alive_28d = 1 AND scr_28d <= 1.5 * scr_baseline_7d THEN 1 ELSE 0 END
    AS renal_recovery_28d_scr FROM outc""", num=["scr_baseline"], plain=["stay_id", "renal_recovery_28d_scr"]))
def outcomes_7d_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Sensitivity analysis: baseline value from the 7 days before t0."""
    s, cohort = _start(spark, sf, baseline_days=7)
    return s.outcomes(cohort).select("scr_baseline", "stay_id", "renal_recovery_28d_scr")


def _frame_sql(risk: str) -> str:
    return oracle(f"""SELECT k.stay_id || '_' || k.strategy AS clone_id, k.hour_index, k.censor_k_total, k.uo_mlkgph_last6h, b.age, b.gender AS sex,
        b.weight_kg, b.cci AS charlson_comorbidity_index, b.ne_eq_baseline, b.mv_baseline, b.pf_ratio AS pfratio, b.lactate, b.ph,
        b.scr AS scr_baseline_win, b.k AS potassium FROM clone_full k LEFT JOIN base b ON b.stay_id = k.stay_id WHERE {risk}""",
        num=["uo_mlkgph_last6h", "age", "weight_kg", "ne_eq_baseline", "pfratio", "lactate", "ph", "scr_baseline_win", "potassium"],
        plain=["clone_id", "hour_index", "censor_k_total", "sex", "charlson_comorbidity_index", "mv_baseline"])


_FRAME_COLUMNS = [
    "clone_id", "hour_index", "censor_k_total", "uo_mlkgph_last6h", "age", "sex", "weight_kg", "charlson_comorbidity_index",
    "ne_eq_baseline", "mv_baseline", "pfratio", "lactate", "ph", "scr_baseline_win", "potassium",
]


def full_frame(s: Study, cohort: DataFrame) -> DataFrame:
    """Analysis frame with all covariates, as a stage."""
    base = stage(s.baseline(cohort), "baseline")
    return stage(s.analysis_frame(s.clone_panel(cohort), base), "analysis")


@query("analysis_frame", _frame_sql("k.total_censor_time IS NULL OR k.total_censor_time > k.t_start"))
def analysis_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Clone-hours at risk when the slice starts, with renamed baseline columns."""
    s, cohort = _start(spark, sf)
    return full_frame(s, cohort).select(*_FRAME_COLUMNS)


@query("analysis_frame_after", _frame_sql("k.at_risk_after_k = 1"))
def analysis_frame_after(spark: SparkSession, sf: str) -> DataFrame:
    """Clone-hours still at risk when the slice ends: the censoring flag is 0 throughout."""
    s, cohort = _start(spark, sf, risk="after")
    return full_frame(s, cohort).select(*_FRAME_COLUMNS)


_OUTCOME_PLAIN = ["death_7d", "alive_7d", "death_28d", "alive_28d", "renal_recovery_28d_scr"]


@query("merged_dataset", oracle("""SELECT k.*, b.* EXCLUDE (subject_id, hadm_id, stay_id, t0_time), o.deathtime, o.death_7d, o.alive_7d, o.death_28d, o.alive_28d,
    o.scr_baseline, o.scr_28d, CASE WHEN o.alive_28d = 1 AND o.scr_28d <= 1.5 * o.scr_baseline THEN 1 ELSE 0 END AS renal_recovery_28d_scr
    FROM clone_full k JOIN base b ON b.stay_id = k.stay_id JOIN outc o ON o.stay_id = k.stay_id""",
    ts=[*_PANEL_TS, *_CENSOR_TS, "intime", "outtime", "deathtime"], num=[*_PANEL_NUM, *_BASE_NUM, "scr_baseline", "scr_28d"],
    plain=[*_PANEL_PLAIN, "strategy", *_CENSOR_FLAGS, "gender", "race", "insurance", "cci", "mv_baseline", "vaso_baseline", "sofa_baseline", *_OUTCOME_PLAIN]))
def merged_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """The cloned hourly panel with baseline and outcomes, exported as CSV and read back."""
    s, cohort = _start(spark, sf)
    base = stage(s.baseline(cohort), "baseline")
    full = censor.merged_dataset(s.clone_panel(cohort), base, s.outcomes(cohort))
    path = f"{shared_dir(spark)}/merged-{uuid.uuid4().hex}"
    write_csv(full, path)
    return read_csv(spark, path, full.schema)
