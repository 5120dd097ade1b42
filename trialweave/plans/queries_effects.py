"""Queries for weights, survival curves, contrasts and diagnostics.

The checked queries use the saturated hazard model: arm x hour for the numerator, arm x hour
x drug x ventilation for the denominator.  Its weights follow from group means, so SQL can
repeat them; the model-based weights are checked through the score equations of the fit.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.operators import censor, diagnostics, logit, panel, pooled, survival, weights
from trialweave.operators.joins import left_join
from trialweave.operators.lookups import gather, gather_slices
from trialweave.plans import oracle_inputs, proxies  # noqa: F401
from trialweave.plans.queries_study import full_frame
from trialweave.plans.registry import cte, oracle, query
from trialweave.plans.study import Study
from trialweave.sources import read_csv, shared_dir, stage, write_csv

_NUM_CELLS = ["strategy", "hour_index"]
_DEN_CELLS = [*_NUM_CELLS, "vaso_flag_last1h", "mv_flag_last1h"]
_KEYS = ["stay_id", "strategy", "hour_index"]


def _risk_rows(spark: SparkSession, sf: str, **params) -> tuple[Study, DataFrame, DataFrame]:
    """Clone-hours at risk with the two covariates of the saturated model, as a stage."""
    s = proxies.study(spark, sf, staged=True, **params)
    cohort = proxies.relaxed_cohort(s)
    at_t0, _ = s.panel_lookups()
    units = s.with_ends(cohort)
    flags = [s.drug_overlap("vaso_flag_last1h", 1), s.ventilated("mv_flag_last1h", 1)]
    known = gather(units, "stay_id", "t0_time", at_t0[1:])
    hours = gather_slices(units.select("stay_id", "t0_time"), "stay_id", "t0_time", 24, flags, known)
    clones = censor.clone_censor(hours, s.params.grace_h)
    return s, cohort, stage(clones.filter(censor.at_risk("start")), "risk-rows")


def _hazards(rows: DataFrame) -> DataFrame:
    return weights.cell_hazards(rows, {"p_num": _NUM_CELLS, "p_denom": _DEN_CELLS})


def _weighted(spark: SparkSession, sf: str, mode: str = "documented", **params) -> tuple[Study, DataFrame, DataFrame]:
    s, cohort, rows = _risk_rows(spark, sf, **params)
    raw = stage(weights.stabilized_weights(_hazards(rows), "p_num", "p_denom", mode), "ipcw")
    return s, cohort, weights.truncate_weights(raw)


def _survival(spark: SparkSession, sf: str, **params) -> tuple[Study, DataFrame, DataFrame]:
    s, cohort, weighted = _weighted(spark, sf, **params)
    outcome = left_join(cohort, s.tables["admissions"], "hadm_id", ["deathtime"])
    died = (F.col("deathtime") > F.col("t0_time")) & (
        F.col("deathtime") <= F.col("t0_time") + F.expr("INTERVAL 28 DAY")
    )
    outcome = outcome.withColumn("death_28d", F.when(died, 1).otherwise(0))
    return s, cohort, s.survival_frame(weighted, outcome)


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    _, _, rows = _survival(spark, sf)
    return stage(survival.weighted_km(stage(rows, "survival"), weight="ipcw_trunc_last"), "curve")


# --- weights ---------------------------------------------------------------------------------

@query("cell_hazard", oracle("SELECT * FROM hazards", num=["p_num", "p_denom"], plain=_KEYS))
def cell_hazard(spark: SparkSession, sf: str) -> DataFrame:
    _, _, rows = _risk_rows(spark, sf)
    return _hazards(rows).select("p_num", "p_denom", *_KEYS)


@query("weights_saturated", oracle("SELECT * FROM ipcw_rows", num=["w_slice", "ipcw"], plain=_KEYS))
def weights_saturated(spark: SparkSession, sf: str) -> DataFrame:
    """Stabilised weights, (1 - numerator) / (1 - denominator)."""
    _, _, rows = _risk_rows(spark, sf)
    return weights.stabilized_weights(_hazards(rows), "p_num", "p_denom").select("w_slice", "ipcw", *_KEYS)


@query("weights_as_coded", oracle("SELECT *, w_coded AS w_slice_c FROM ipcw_rows", num=["w_slice_c", "ipcw_coded"], plain=_KEYS))
def weights_as_coded(spark: SparkSession, sf: str) -> DataFrame:
    """The reciprocal form of the same weights."""
    _, _, rows = _risk_rows(spark, sf)
    out = weights.stabilized_weights(_hazards(rows), "p_num", "p_denom", "as_coded")
    return out.select(F.col("w_slice").alias("w_slice_c"), F.col("ipcw").alias("ipcw_coded"), *_KEYS)


@query("weights_truncated", oracle("SELECT * FROM trunc_rows", num=["ipcw", "ipcw_trunc"], plain=_KEYS))
def weights_truncated(spark: SparkSession, sf: str) -> DataFrame:
    _, _, weighted = _weighted(spark, sf)
    return weighted.select("ipcw", "ipcw_trunc", *_KEYS)


@query("last_weight", oracle("SELECT stay_id, strategy, w AS ipcw_trunc_last FROM clone_w", num=["ipcw_trunc_last"], plain=["stay_id", "strategy"]))
def last_weight(spark: SparkSession, sf: str) -> DataFrame:
    """Weight of each clone at its last uncensored slice."""
    _, _, weighted = _weighted(spark, sf)
    return weights.last_weight(weighted.filter(F.col("at_risk_after_k") == 1))


# The name in the model -> the SQL of the term.
_TERM_SQL = {
    "age": "age", "weight_kg": "weight_kg", "charlson_comorbidity_index": "cci", "ne_eq_baseline": "ne_eq_baseline",
    "mv_baseline": "mv_baseline", "pfratio": "pf_ratio", "lactate": "lactate", "ph": "ph", "scr_baseline_win": "scr",
    "potassium": "k", "uo_mlkgph_last6h": "uo_mlkgph_last6h", "map_last1h": "map_last1h", "vaso_flag_last1h": "vaso_flag_last1h",
    "ne_eq_last1h": "ne_eq_last1h", "mv_flag_last1h": "mv_flag_last1h", "lactate_last6h": "lactate_last6h", "ph_last6h": "ph_last6h",
    "k_last6h": "k_last6h", "scr_last6h": "scr_last6h",
}
_BASELINE_TERMS = (
    "strategy", "age", "sex", "weight_kg", "charlson_comorbidity_index", "ne_eq_baseline", "mv_baseline", "pfratio", "lactate", "ph",
    "scr_baseline_win", "potassium",
)
cte("model_rows", """SELECT c.*, b.age, b.gender, b.weight_kg, b.cci, b.ne_eq_baseline, b.mv_baseline, b.pf_ratio, b.lactate, b.ph, b.scr, b.k
    FROM clone_full c JOIN base b ON b.stay_id = c.stay_id WHERE c.total_censor_time IS NULL OR c.total_censor_time > c.t_start""")
_ALL_KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in ("gender", *_TERM_SQL.values()))
cte("full_rows", f"SELECT * FROM model_rows WHERE {_ALL_KNOWN}")
_BASE_KNOWN = " AND ".join(f"{_TERM_SQL[c]} IS NOT NULL" for c in _BASELINE_TERMS if c in _TERM_SQL)
cte("baseline_rows", f"SELECT * FROM model_rows WHERE gender IS NOT NULL AND {_BASE_KNOWN}")


@query("weights_glm", oracle("""SELECT stay_id, strategy, hour_index, censor_k_total FROM full_rows""", plain=[*_KEYS, "censor_k_total"]))
def weights_glm(spark: SparkSession, sf: str) -> DataFrame:
    """Clone-hours with weights from the two pooled logistic models, all 21 terms: which rows have one.

    A weight is unknown from a clone's first incomplete hour on, so a known one shows that all
    rows up to it were scored; the probabilities themselves are checked by the score equations.
    """
    s = proxies.study(spark, sf)
    out = s.weighted(full_frame(s, proxies.relaxed_cohort(s)))
    known = F.col("p_denom").isNotNull() & F.col("p_denom").between(0, 1) & F.col("p_num").isNotNull()
    return out.filter(known).select(*_KEYS, "censor_k_total")


def _observed(rows: str, terms: Sequence[str]) -> str:
    """SQL of the observed total of every term, which maximum likelihood makes the expected one."""
    parts = [f"SELECT '{n}' AS term, sum(censor_k_total * {c}) AS total FROM {rows}" for n, c in _TERM_SQL.items() if n in terms]
    levels = [("strategy", "strategy"), ("sex", "gender"), ("hour", "hour_index")]
    parts += [f"SELECT '{n}=' || {c}, sum(censor_k_total) FROM {rows} GROUP BY {c}" for n, c in levels]
    parts.append(f"SELECT 'rows', count(*) FROM {rows}")
    return "SELECT term, round(CAST(total AS DOUBLE), 3) AS total FROM (" + " UNION ALL ".join(parts) + ") y"


def _expected(frame: DataFrame, model: logit.LogitModel) -> DataFrame:
    """The expected total of every term under a fitted model, and the number of rows it scores."""
    scored = weights.predict_hazard(frame, model, "p").filter(F.col("p").isNotNull())
    cells = [
        F.concat(F.lit(f"{label}="), F.col(c).cast("string"))
        for label, c in (("strategy", "strategy"), ("sex", "sex"), ("hour", "hour_index"))
    ]
    terms = [F.struct(F.lit(n).alias("term"), F.col(n).cast("double").alias("x")) for n in _TERM_SQL if n in model.spec.terms]
    terms += [F.struct(c.alias("term"), F.lit(1.0).alias("x")) for c in cells]
    long = scored.select("p", F.explode(F.array(*terms)).alias("t"))
    totals = long.groupBy("t.term").agg(F.sum(F.col("p") * F.col("t.x")).alias("total"))
    rows = scored.agg(F.count("*").cast("double").alias("total")).select(F.lit("rows").alias("term"), "total")
    return totals.unionAll(rows).select((F.round("total", 3) + 0.0).alias("total"), "term")


def _both_models(spark: SparkSession, sf: str) -> tuple[DataFrame, list[logit.LogitModel]]:
    s = proxies.study(spark, sf)
    frame = full_frame(s, proxies.relaxed_cohort(s))
    return frame, weights.censor_models(frame, [logit.ModelSpec(t) for t in (s.params.denominator_terms, _BASELINE_TERMS)])


@query("denominator_score_equations", oracle(_observed("full_rows", tuple(_TERM_SQL)), num=["total"], plain=["term"]))
def denominator_score_equations(spark: SparkSession, sf: str) -> DataFrame:
    """Expected total of every term of the 21-term denominator model, hours and levels included.

    At the maximum of the likelihood these equal the observed totals, term by term, which
    holds for no other coefficients.
    """
    frame, (model, _) = _both_models(spark, sf)
    return _expected(frame, model)


@query("weights_glm_baseline_numerator", oracle(_observed("baseline_rows", _BASELINE_TERMS), num=["total"], plain=["term"]))
def weights_glm_baseline_numerator(spark: SparkSession, sf: str) -> DataFrame:
    """The same for the numerator with baseline covariates, fitted together with the denominator."""
    frame, (_, model) = _both_models(spark, sf)
    return _expected(frame, model)


@query("hazard_score_equations", oracle("""SELECT * FROM (SELECT hour_index, strategy, round(CAST(sum(censor_k_total) AS DOUBLE), 3) AS expected FROM risk_rows
    GROUP BY CUBE (hour_index, strategy)) q WHERE hour_index IS NULL OR strategy IS NULL""", num=["expected"], plain=["hour_index", "strategy"]))
def hazard_score_equations(spark: SparkSession, sf: str) -> DataFrame:
    """Expected censorings of the fitted numerator model per hour and per arm.

    Maximum likelihood makes them equal to the observed numbers, which SQL can count.
    """
    _, _, rows = _risk_rows(spark, sf)
    model = weights.censor_model(rows, weights.NUMERATOR_TERMS, merge=True)
    scored = weights.predict_hazard(rows, model, "p_num")
    sums = (
        scored.groupBy("hour_index", "strategy").agg(F.sum("p_num").alias("expected"))
        .cube("hour_index", "strategy").agg(F.sum("expected").alias("expected"))
        .filter(F.col("hour_index").isNull() | F.col("strategy").isNull())
    )
    return sums.select((F.round("expected", 3) + 0.0).alias("expected"), "hour_index", "strategy")


def _newton_logit(factor: str, steps: int = 25) -> str:
    """Newton steps of a logistic model, arm B beside a factor, folded over lists of its levels.

    A level is its number of rows and events by arm; levels without events stay at 0 and those
    with events only at 1, as the likelihood has it in the limit.
    """
    at = "(1 / (1 + exp(-(c.a + s.b))))", "(1 / (1 + exp(-c.a)))"
    v1, v0 = (f"(c.{n} * {p} * (1 - {p}))" for n, p in zip(("n1", "n0"), at))
    r1, r0 = (f"(c.{y} - c.{n} * {p})" for y, n, p in zip(("y1", "y0"), ("n1", "n0"), at))
    right = f"list_sum(list_transform(s.cells, lambda c: {r1} - {v1} * ({r1} + {r0}) / ({v1} + {v0})))"
    inner = f"list_sum(list_transform(s.cells, lambda c: {v1} - {v1} * {v1} / ({v1} + {v0})))"
    moved = f"struct_pack(f := c.f, n1 := c.n1, n0 := c.n0, y1 := c.y1, y0 := c.y0, a := c.a + ({r1} + {r0} - {v1} * {right} / {inner}) / ({v1} + {v0}))"
    return f"""
SELECT u.c.f AS f, 1 / (1 + exp(-(u.c.a + b))) AS p_b, 1 / (1 + exp(-u.c.a)) AS p_a FROM (
  SELECT z.b, unnest(z.cells) AS c FROM (SELECT list_reduce(list_transform(range({steps + 1}), lambda i: struct_pack(b := 0.0::DOUBLE, cells := cells)),
    lambda s, i: struct_pack(b := s.b + {right} / {inner}, cells := list_transform(s.cells, lambda c: {moved}))) AS z FROM (
    SELECT list(struct_pack(f := f, n1 := n1, n0 := n0, y1 := y1, y0 := y0, a := ln((y1 + y0) / (n1 + n0 - y1 - y0)))) AS cells FROM levels_{factor}
    WHERE y1 + y0 > 0 AND y1 + y0 < n1 + n0) l) t) u
UNION ALL SELECT f, (y1 + y0) / (n1 + n0), (y1 + y0) / (n1 + n0) FROM levels_{factor} WHERE y1 + y0 <= 0 OR y1 + y0 >= n1 + n0"""


cte("levels_hour_index", """
SELECT hour_index AS f, CAST(count(*) FILTER (strategy = 'B') AS DOUBLE) AS n1, CAST(count(*) FILTER (strategy = 'A') AS DOUBLE) AS n0,
  CAST(coalesce(sum(censor_k_total) FILTER (strategy = 'B'), 0) AS DOUBLE) AS y1, CAST(coalesce(sum(censor_k_total) FILTER (strategy = 'A'), 0) AS DOUBLE) AS y0
FROM risk_rows GROUP BY hour_index""")
cte("arm_hour_model", _newton_logit("hour_index"))
cte("hour_model", "SELECT f, (y1 + y0) / (n1 + n0) AS p_hour FROM levels_hour_index")


@query("weights_glm_discrete", oracle("""SELECT stay_id, strategy, hour_index, p_denom, p_num, product((1 - p_num) / (1 - p_denom)) OVER
    (PARTITION BY stay_id, strategy ORDER BY hour_index ROWS UNBOUNDED PRECEDING) AS ipcw FROM (
      SELECT r.stay_id, r.strategy, r.hour_index, CASE WHEN r.strategy = 'B' THEN m.p_b ELSE m.p_a END AS p_denom, h.p_hour AS p_num
      FROM risk_rows r JOIN arm_hour_model m ON m.f = r.hour_index JOIN hour_model h ON h.f = r.hour_index) q""",
    num=["p_denom", "p_num", "ipcw"], plain=_KEYS))
def weights_glm_discrete(spark: SparkSession, sf: str) -> DataFrame:
    """Weights from two fitted models of discrete terms: arm and hour against the hour alone."""
    _, _, rows = _risk_rows(spark, sf)
    den, num = weights.censor_models(rows, [logit.ModelSpec(("strategy",)), logit.ModelSpec(())], merge=True)
    scored = weights.predict_hazard(weights.predict_hazard(rows, den, "p_denom"), num, "p_num")
    return weights.stabilized_weights(scored, "p_num", "p_denom").select("p_denom", "p_num", "ipcw", *_KEYS)


# --- survival --------------------------------------------------------------------------------

@query("time_to_event", oracle("SELECT stay_id, strategy, time, event FROM surv_rows", num=["time"], plain=["stay_id", "strategy", "event"]))
def time_to_event(spark: SparkSession, sf: str) -> DataFrame:
    """Days to death or 28 days; survivors are followed to the end."""
    _, _, rows = _survival(spark, sf)
    return rows.select("time", "stay_id", "strategy", "event")


@query("time_to_event_as_coded", oracle("""SELECT c.stay_id, c.strategy, CASE WHEN o.deathtime IS NOT NULL THEN
    least((epoch_us(o.deathtime) - epoch_us(o.t0_time)) / 86400000000.0::DOUBLE, 28.0::DOUBLE) END AS time, o.death_28d AS event
    FROM clone_w c JOIN outc o ON o.stay_id = c.stay_id""", num=["time"], plain=["stay_id", "strategy", "event"]))
def time_to_event_as_coded(spark: SparkSession, sf: str) -> DataFrame:
    """The same with missing time for survivors and units dead at t0 kept."""
    _, _, rows = _survival(spark, sf, as_coded_survivors=True)
    return rows.select("time", "stay_id", "strategy", "event")


@query("time_to_event_stopped", oracle("""SELECT s.stay_id, s.strategy,
    least(s.time, (epoch_us(k.stop) - epoch_us(s.t0_time)) / 86400000000.0::DOUBLE) AS time,
    CASE WHEN s.event = 1 AND (k.stop IS NULL OR s.deathtime <= k.stop) THEN 1 ELSE 0 END AS event
    FROM surv_rows s JOIN (SELECT stay_id, strategy, max(total_censor_time) AS stop FROM risk_rows GROUP BY stay_id, strategy) k
    ON k.stay_id = s.stay_id AND k.strategy = s.strategy""", num=["time"], plain=["stay_id", "strategy", "event"]))
def time_to_event_stopped(spark: SparkSession, sf: str) -> DataFrame:
    """Follow-up that ends at the clone's own censoring time."""
    _, _, rows = _survival(spark, sf, stop_at_censor=True)
    return rows.select("time", "stay_id", "strategy", "event")


@query("km_weighted", oracle("SELECT * FROM km_rows", num=["time", "n_event", "n_risk", "surv", "std_err"], plain=["strategy", "count_event", "count_risk"]))
def km_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _curve(spark, sf).select(
        "time", "n_event", "n_risk", "surv", "std_err", "strategy", "count_event", "count_risk"
    )


@query("km_interval", oracle("""SELECT strategy, time, surv * exp(-1.959963984540054 * std_err) AS lower,
    least(1.0, surv * exp(1.959963984540054 * std_err)) AS upper FROM km_rows""", num=["time", "lower", "upper"], plain=["strategy"]))
def km_interval(spark: SparkSession, sf: str) -> DataFrame:
    """95 % limits of the curve."""
    return _curve(spark, sf).select("time", "lower", "upper", "strategy")


@query("km_unweighted_stages", oracle("""SELECT strategy, lactate_2grp, time, product(1 - d / n) OVER (PARTITION BY strategy, lactate_2grp ORDER BY time ROWS UNBOUNDED PRECEDING) AS surv
    FROM (SELECT *, sum(m) OVER (PARTITION BY strategy, lactate_2grp ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS n FROM (
      SELECT s.strategy, f.lactate_2grp, s.time, count(*) AS m, sum(s.event) AS d FROM surv_rows s JOIN sub_flags f ON f.stay_id = s.stay_id
      GROUP BY ALL) a) b""", num=["time", "surv"], plain=["strategy", "lactate_2grp"]))
def km_unweighted_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Unweighted curves by arm and subgroup."""
    s, cohort, rows = _survival(spark, sf)
    flags = s.subgroups(stage(s.baseline(cohort), "baseline"), creat_stage="aki_stage_creat")
    both = left_join(rows, flags, "stay_id", ["lactate_2grp"])
    curves = survival.weighted_km(stage(both, "by-level"), by=["strategy", "lactate_2grp"])
    return curves.select("time", "surv", "strategy", "lactate_2grp")


@query("km_grid", oracle("SELECT strategy, time, surv, 1 - surv AS risk FROM km_grid", num=["time", "surv", "risk"], plain=["strategy"]))
def km_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Curve values every half day."""
    at = survival.km_at(_curve(spark, sf), survival.time_grid(0, 28, 0.5))
    return at.select("time", "surv", "risk", "strategy")


@query("risk_table", oracle("""SELECT s.strategy, CAST(i * 7 AS DOUBLE) AS time, count(*) FILTER (WHERE r.time >= i * 7) AS count_risk,
    coalesce(sum(r.w) FILTER (WHERE r.time >= i * 7), 0) AS n_risk FROM range(5) g(i) CROSS JOIN (VALUES ('A'), ('B')) s(strategy)
    JOIN surv_rows r ON r.strategy = s.strategy WHERE r.w IS NOT NULL GROUP BY s.strategy, i""", num=["time", "n_risk"], plain=["strategy", "count_risk"]))
def risk_table(spark: SparkSession, sf: str) -> DataFrame:
    """Number at risk at 0, 7, 14, 21 and 28 days."""
    return survival.risk_table(_curve(spark, sf), [0, 7, 14, 21, 28]).select("time", "n_risk", "strategy", "count_risk")


_RD = """SELECT a.time, (1 - a.surv) - (1 - b.surv) AS rd, 'A - B' AS arm_contrast FROM km_grid a JOIN km_grid b ON a.time = b.time
    WHERE a.strategy = 'A' AND b.strategy = 'B'"""


@query("risk_difference", oracle(_RD, num=["time", "rd"], plain=["arm_contrast"]))
def risk_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Difference in risk between the arms, every half day."""
    return survival.risk_difference(survival.km_at(_curve(spark, sf), survival.time_grid(0, 28, 0.5)))


@query("risk_difference_28d", oracle(_RD + " AND a.time = 28", num=["time", "rd"], plain=["arm_contrast"]))
def risk_difference_28d(spark: SparkSession, sf: str) -> DataFrame:
    return survival.risk_difference(survival.km_at(_curve(spark, sf), [28.0]))


cte("km_area", """
SELECT strategy, time, surv, n_event, n_risk, lead(time, 1, 28.0) OVER (PARTITION BY strategy ORDER BY time) - time AS width
FROM (SELECT strategy, time, surv, n_event, n_risk FROM km_rows WHERE time < 28
      UNION ALL SELECT strategy, 0.0, 1.0, 0, 1 FROM (SELECT DISTINCT strategy FROM km_rows) z) q""")

cte("rmst_rows", """
SELECT strategy, sum(surv * width) AS rmst, sqrt(sum(tail * tail * CASE WHEN n_event > 0 AND n_event < n_risk
  THEN n_event / (n_risk * (n_risk - n_event)) ELSE 0 END)) AS rmst_se
FROM (SELECT *, sum(surv * width) OVER (PARTITION BY strategy ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS tail FROM km_area) q
GROUP BY strategy""")


@query("rmst", oracle("SELECT strategy, rmst, rmst_se, 28 - rmst AS rmtl FROM rmst_rows", num=["rmst", "rmst_se", "rmtl"], plain=["strategy"]))
def rmst(spark: SparkSession, sf: str) -> DataFrame:
    """Restricted mean survival and time lost to 28 days per arm."""
    return survival.rmst(_curve(spark, sf)).select("rmst", "rmst_se", "rmtl", "strategy")


@query("rmst_contrast", oracle("""SELECT 'rmst_difference' AS contrast, a.rmst - b.rmst AS estimate FROM rmst_rows a, rmst_rows b WHERE a.strategy = 'A' AND b.strategy = 'B'
    UNION ALL SELECT 'rmst_ratio', a.rmst / b.rmst FROM rmst_rows a, rmst_rows b WHERE a.strategy = 'A' AND b.strategy = 'B'
    UNION ALL SELECT 'rmtl_ratio', (28 - a.rmst) / (28 - b.rmst) FROM rmst_rows a, rmst_rows b WHERE a.strategy = 'A' AND b.strategy = 'B'""",
    num=["estimate"], plain=["contrast"]))
def rmst_contrast(spark: SparkSession, sf: str) -> DataFrame:
    return survival.rmst_contrast(survival.rmst(_curve(spark, sf))).select("estimate", "contrast")


@query("rmst_report", oracle("SELECT strategy, rmst, 28 - rmst AS rmtl FROM rmst_rows", num=["rmst", "rmtl"], plain=["strategy"]))
def rmst_report(spark: SparkSession, sf: str) -> DataFrame:
    """The result table as a CSV report, read back."""
    path = f"{shared_dir(spark)}/rmst-{uuid.uuid4().hex}"
    table = survival.rmst(_curve(spark, sf)).select("strategy", "rmst", "rmtl")
    write_csv(table, path, single_file=True)
    return read_csv(spark, path, table.schema).select("rmst", "rmtl", "strategy")


def _report(spark: SparkSession, table: DataFrame, name: str) -> DataFrame:
    """A result table written as one CSV file and read back."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write_csv(table, path, single_file=True)
    return read_csv(spark, path, table.schema)


@query("risk_difference_report", oracle(_RD, num=["time", "rd"], plain=["arm_contrast"]))
def risk_difference_report(spark: SparkSession, sf: str) -> DataFrame:
    """The risk-difference curve as a CSV report, read back."""
    curve = survival.km_at(_curve(spark, sf), survival.time_grid(0, 28, 0.5))
    return _report(spark, survival.risk_difference(curve), "risk-difference")


# --- Cox -------------------------------------------------------------------------------------

def _newton(rows: str, group: str, steps: int = 12, prefix: str = "cx", entry: bool = False) -> str:
    """Newton iterations of the weighted Efron partial likelihood, treated arm B, folded over lists.

    With ``entry`` rows are at risk in (start, time], found by a range join per event time.
    Where the likelihood has no maximum, as without events in both arms, there is no row.
    """
    prefix = f"{prefix}_{group}"
    if entry:
        cte(f"{prefix}_r", f"SELECT {group} AS grp, start, time, strategy, w, event FROM ({rows}) r WHERE w IS NOT NULL")
        cte(f"{prefix}_t", f"""
SELECT t.grp, t.time, t.d1, t.d0, t.k, coalesce(sum(r.w) FILTER (r.strategy = 'B'), 0) AS r1, coalesce(sum(r.w) FILTER (r.strategy = 'A'), 0) AS r0
FROM (SELECT grp, time, coalesce(sum(w) FILTER (strategy = 'B'), 0) AS d1, coalesce(sum(w) FILTER (strategy = 'A'), 0) AS d0, count(*) AS k
  FROM {prefix}_r WHERE event = 1 GROUP BY grp, time) t
JOIN {prefix}_r r ON r.grp = t.grp AND r.start < t.time AND r.time >= t.time GROUP BY ALL""")
    else:
        cte(f"{prefix}_t", f"""
SELECT grp, time, d1, d0, k, sum(w1) OVER down AS r1, sum(w0) OVER down AS r0 FROM (
  SELECT {group} AS grp, time, sum(CASE WHEN strategy = 'B' THEN w ELSE 0 END) AS w1, sum(CASE WHEN strategy = 'A' THEN w ELSE 0 END) AS w0,
    sum(CASE WHEN strategy = 'B' THEN w * event ELSE 0 END) AS d1, sum(CASE WHEN strategy = 'A' THEN w * event ELSE 0 END) AS d0, sum(event) AS k
  FROM ({rows}) r WHERE w IS NOT NULL GROUP BY grp, time) q
WINDOW down AS (PARTITION BY grp ORDER BY time DESC ROWS UNBOUNDED PRECEDING)""")
    # per event: the mean deaths in both arms, those in arm B, and what is left of both risk sets
    cte(f"{prefix}_x", f"""
SELECT grp, list(struct_pack(d := (d0 + d1) / k, e := d1 / k, t := r1 - l / CAST(k AS DOUBLE) * d1, c := r0 - l / CAST(k AS DOUBLE) * d0)) AS xs
FROM (SELECT *, unnest(range(CAST(k AS BIGINT))) AS l FROM {prefix}_t WHERE k > 0) z GROUP BY grp
HAVING max(d1) > 0 AND max(d0) > 0""")
    m = "(exp(b) * x.t / (exp(b) * x.t + x.c))"
    score = f"list_sum(list_transform(xs, lambda x: x.e - x.d * {m}))"
    info = f"list_sum(list_transform(xs, lambda x: x.d * {m} * (1 - {m})))"
    cte(f"{prefix}_b", f"""
SELECT grp, xs, list_reduce([0.0::DOUBLE] || CAST(range({steps}) AS DOUBLE[]), lambda b, i: b + {score} / {info}) AS b FROM {prefix}_x""")
    return f"SELECT grp, b AS log_hr, exp(b) AS hr, 1 / sqrt({info}) AS se FROM {prefix}_b WHERE abs({score} / {info}) < 1e-6"


_COX = _newton("SELECT *, 'all' AS everyone FROM surv_rows", "everyone")


def _normal_tail(z: str) -> str:
    """Two-sided p-value in SQL: Simpson's rule over the density."""
    weight = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(1 - sqrt(2 / pi()) * {z} / 6000 * list_sum(list_transform(range(2001), lambda i: ({weight}) * exp(-power({z} * i / 2000, 2) / 2))))"


@query("cox_weighted", oracle(f"""SELECT *, log_hr / se AS z, {_normal_tail("abs(log_hr / se)")} AS p, log_hr - 1.959963984540054::DOUBLE * se AS log_lower,
    log_hr + 1.959963984540054::DOUBLE * se AS log_upper, exp(log_hr - 1.959963984540054::DOUBLE * se) AS hr_lower,
    exp(log_hr + 1.959963984540054::DOUBLE * se) AS hr_upper FROM ({_COX}) c""", num=["log_hr", "hr", "se", "z", "p", "log_lower", "log_upper", "hr_lower", "hr_upper"]))
def cox_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted Cox effect of arm B against arm A, ties by Efron."""
    _, _, rows = _survival(spark, sf)
    return survival.weighted_cox(stage(rows, "survival"), weight="ipcw_trunc_last").select(
        "log_hr", "hr", "se", "z", "p", "log_lower", "log_upper", "hr_lower", "hr_upper"
    )


def _robust_sql(fit: str, rows: str, group: str, prefix: str = "cx") -> str:
    """A fit of ``_newton`` with the variance robust to clones of one unit, from Efron's score residuals.

    Every row gets its own hazard by a range join; one that dies among ties leaves their risk
    sets step by step.
    """
    name = f"{prefix}_{group}"
    cte(f"{name}_fit", fit)
    cte(f"{name}_steps", f"""
SELECT t.grp, t.time, l / CAST(k AS DOUBLE) AS share, (d0 + d1) / k AS m, exp(f.log_hr) * (r1 - l / CAST(k AS DOUBLE) * d1) AS part,
  exp(f.log_hr) * (r1 - l / CAST(k AS DOUBLE) * d1) + r0 - l / CAST(k AS DOUBLE) * d0 AS whole
FROM (SELECT *, unnest(range(CAST(k AS BIGINT))) AS l FROM {name}_t WHERE k > 0) t JOIN {name}_fit f ON f.grp = t.grp""")
    cte(f"{name}_hazard", f"""
SELECT grp, time, sum(m / whole) AS h, sum(m / whole * part / whole) AS hm, sum((1 - share) * m / whole) AS h_tied,
  sum((1 - share) * m / whole * part / whole) AS hm_tied, avg(part / whole) AS mean FROM {name}_steps GROUP BY grp, time""")
    cte(f"{name}_residual", f"""
SELECT q.grp, q.stay_id, q.w * (CASE WHEN q.event = 1 THEN q.x - mean ELSE 0 END - exp(log_hr * q.x) * (q.x * h - hm)) AS u FROM (
  SELECT r.grp, r.stay_id, r.w, r.event, r.x, any_value(f.log_hr) AS log_hr, any_value(z.mean) FILTER (z.time = r.time) AS mean,
    coalesce(sum(CASE WHEN r.event = 1 AND z.time = r.time THEN z.h_tied ELSE z.h END), 0) AS h,
    coalesce(sum(CASE WHEN r.event = 1 AND z.time = r.time THEN z.hm_tied ELSE z.hm END), 0) AS hm
  FROM (SELECT {group} AS grp, stay_id, time, w, event, CASE WHEN strategy = 'B' THEN 1 ELSE 0 END AS x, row_number() OVER () AS n FROM ({rows}) a WHERE w IS NOT NULL) r
  JOIN {name}_fit f ON f.grp = r.grp LEFT JOIN {name}_hazard z ON z.grp = r.grp AND z.time <= r.time GROUP BY r.n, r.grp, r.stay_id, r.time, r.w, r.event, r.x) q""")
    return f"""SELECT *, log_hr / robust_se AS z, {_normal_tail("abs(log_hr / robust_se)")} AS p, log_hr - 1.959963984540054::DOUBLE * robust_se AS log_lower,
    log_hr + 1.959963984540054::DOUBLE * robust_se AS log_upper, exp(log_hr - 1.959963984540054::DOUBLE * robust_se) AS hr_lower,
    exp(log_hr + 1.959963984540054::DOUBLE * robust_se) AS hr_upper FROM (
      SELECT f.grp, any_value(f.log_hr) AS log_hr, any_value(f.hr) AS hr, any_value(f.se) AS se, sqrt(sum(c.u * c.u)) * any_value(f.se) * any_value(f.se) AS robust_se
      FROM {name}_fit f JOIN (SELECT grp, stay_id, sum(u) AS u FROM {name}_residual GROUP BY grp, stay_id) c ON c.grp = f.grp GROUP BY f.grp) v"""


_ROBUST_NUM = ["log_hr", "hr", "se", "robust_se", "z", "p", "log_lower", "log_upper", "hr_lower", "hr_upper"]
_ALL_ROWS = "SELECT *, 'all' AS everyone FROM surv_rows"


@query("cox_robust", oracle(_robust_sql(_COX, _ALL_ROWS, "everyone"), num=_ROBUST_NUM))
def cox_robust(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a standard error robust to clones of one unit, and the limits it gives."""
    _, _, rows = _survival(spark, sf)
    return survival.weighted_cox(stage(rows, "survival"), weight="ipcw_trunc_last", cluster="stay_id").select(*_ROBUST_NUM)


@query("cox_report", oracle(_robust_sql(_COX, _ALL_ROWS, "everyone"), num=_ROBUST_NUM))
def cox_report(spark: SparkSession, sf: str) -> DataFrame:
    """The Cox result table as a CSV report, read back."""
    _, _, rows = _survival(spark, sf)
    table = survival.weighted_cox(stage(rows, "survival"), weight="ipcw_trunc_last", cluster="stay_id")
    return _report(spark, table.select(*_ROBUST_NUM), "cox")


def _subgroup_rows(spark: SparkSession, sf: str) -> DataFrame:
    s, cohort, rows = _survival(spark, sf)
    flags = s.subgroups(stage(s.baseline(cohort), "baseline"), creat_stage="aki_stage_creat")
    return stage(left_join(rows, flags, "stay_id", list(panel.SUBGROUPS)), "by-subgroup")


_LEVELS = " UNION ALL ".join(
    f"SELECT s.*, '{g}|' || f.{g} AS subgroup_level FROM surv_rows s JOIN sub_flags f ON f.stay_id = s.stay_id"
    for g in panel.SUBGROUPS
)
cte("level_rows", _LEVELS)
cte("large_levels", "SELECT * FROM level_rows WHERE subgroup_level IN (SELECT subgroup_level FROM level_rows WHERE w IS NOT NULL GROUP BY 1 HAVING count(*) >= 50)")
_BY_LEVEL = _newton("SELECT * FROM large_levels", "subgroup_level")


@query("subgroup_cox", oracle(f"""SELECT split_part(l.subgroup_level, '|', 1) AS subgroup, split_part(l.subgroup_level, '|', 2) AS level, z.* EXCLUDE (grp), l.n, l.n_event
    FROM (SELECT subgroup_level, count(*) AS n, CAST(sum(event) AS BIGINT) AS n_event FROM large_levels WHERE w IS NOT NULL GROUP BY subgroup_level) l
    LEFT JOIN ({_robust_sql(_BY_LEVEL, "SELECT * FROM large_levels", "subgroup_level")}) z ON z.grp = l.subgroup_level""",
       num=_ROBUST_NUM, plain=["subgroup", "level", "n", "n_event"]))
def subgroup_cox(spark: SparkSession, sf: str) -> DataFrame:
    """Cox effect in every subgroup level with at least 50 clones, in one grouped fit; NULL without events."""
    fits = survival.subgroup_cox(_subgroup_rows(spark, sf), panel.SUBGROUPS, weight="ipcw_trunc_last", cluster="stay_id")
    return fits.select(*_ROBUST_NUM, "subgroup", "level", "n", "n_event")


_Q = f"""SELECT subgroup, count(*) AS levels, count(*) - 1 AS df,
    greatest(sum(log_hr * log_hr / (se * se)) - power(sum(log_hr / (se * se)), 2) / sum(1 / (se * se)), 0) AS q
    FROM (SELECT *, split_part(grp, '|', 1) AS subgroup FROM ({_BY_LEVEL}) f) y GROUP BY subgroup HAVING count(*) > 1"""


@query("subgroup_interaction", oracle(f"""SELECT *, CASE WHEN df % 2 = 1 THEN {_normal_tail("sqrt(q)")} ELSE 0 END + coalesce(exp(-q / 2) * list_sum(list_transform(
    range(df // 2), lambda j: power(q / 2, j + (df % 2) / 2.0) / gamma(j + (df % 2) / 2.0 + 1))), 0) AS p_interaction FROM ({_Q}) t""",
    num=["q", "p_interaction"], plain=["subgroup", "levels", "df"]))
def subgroup_interaction(spark: SparkSession, sf: str) -> DataFrame:
    """Test of treatment x subgroup interaction per subgroup variable."""
    fits = survival.subgroup_cox(_subgroup_rows(spark, sf), panel.SUBGROUPS, weight="ipcw_trunc_last")
    return survival.interaction_test(fits).select("q", "p_interaction", "subgroup", "levels", "df")


# --- the same fits on clone-hours -------------------------------------------------------------

cte("hour_rows", """
SELECT t.stay_id, t.strategy, t.hour_index, t.ipcw_trunc AS w, o.deathtime, o.t0_time, o.death_28d AS event,
  CASE WHEN o.deathtime IS NULL THEN 28.0::DOUBLE ELSE least((epoch_us(o.deathtime) - epoch_us(o.t0_time)) / 86400000000.0::DOUBLE, 28.0::DOUBLE) END AS time
FROM trunc_rows t JOIN outc o ON o.stay_id = t.stay_id
WHERE t.at_risk_after_k = 1 AND (o.deathtime IS NULL OR o.deathtime > o.t0_time)""")

# times to the microsecond, as the operators count them
cte("counting_rows", """
SELECT stay_id, strategy, w, CAST(round(hour_index * 3600000000) AS BIGINT) / 86400000000.0::DOUBLE AS start,
  CASE WHEN hour_index < 23 AND hour_index + 1 < 24 * time THEN CAST(round((hour_index + 1) * 3600000000) AS BIGINT) / 86400000000.0::DOUBLE ELSE time END AS time,
  CASE WHEN hour_index < 23 AND hour_index + 1 < 24 * time THEN 0 ELSE event END AS event
FROM hour_rows WHERE hour_index < 24 * time""")


def _hours(spark: SparkSession, sf: str, counting: bool) -> tuple[Study, DataFrame, DataFrame]:
    s, cohort, weighted = _weighted(spark, sf)
    outcome = left_join(cohort, s.tables["admissions"], "hadm_id", ["deathtime"])
    return s, cohort, censor.clone_hours(weighted, outcome, counting, panel_h=s.params.panel_h, horizon=s.params.horizon_days)


_KM_COLUMNS = ("time", "n_event", "n_risk", "surv", "std_err", "strategy", "count_event", "count_risk")


def _km_sql(rows: str, entry: bool) -> str:
    at_risk = "r.start < t.time AND r.time >= t.time" if entry else "r.time >= t.time"
    prefix = f"km_{rows}"
    cte(f"{prefix}_t", f"""
SELECT t.strategy, t.time, t.n_event, t.count_event, sum(r.w) AS n_risk, count(*) AS count_risk
FROM (SELECT strategy, time, sum(w * event) AS n_event, sum(event) AS count_event FROM {rows} WHERE w IS NOT NULL GROUP BY strategy, time) t
JOIN {rows} r ON r.strategy = t.strategy AND r.w IS NOT NULL AND {at_risk} GROUP BY ALL""")
    cte(prefix, f"""
SELECT strategy, time, CAST(count_event AS BIGINT) AS count_event, n_event, n_risk, CAST(count_risk AS BIGINT) AS count_risk,
  product(1 - n_event / n_risk) OVER up AS surv,
  sqrt(sum(CASE WHEN n_event > 0 AND n_event < n_risk THEN n_event / (n_risk * (n_risk - n_event)) ELSE 0 END) OVER up) AS std_err
FROM {prefix}_t WINDOW up AS (PARTITION BY strategy ORDER BY time ROWS UNBOUNDED PRECEDING)""")
    cte(f"{prefix}_area", f"""
SELECT strategy, time, surv, n_event, n_risk, lead(time, 1, 28.0) OVER (PARTITION BY strategy ORDER BY time) - time AS width
FROM (SELECT strategy, time, surv, n_event, n_risk FROM {prefix} WHERE time < 28
      UNION ALL SELECT strategy, 0.0, 1.0, 0, 1 FROM (SELECT DISTINCT strategy FROM {prefix}) z) q""")
    return prefix


def _rmst_sql(prefix: str) -> str:
    return f"""SELECT strategy, rmst, rmst_se, 28 - rmst AS rmtl FROM (SELECT strategy, sum(surv * width) AS rmst,
  sqrt(sum(tail * tail * CASE WHEN n_event > 0 AND n_event < n_risk THEN n_event / (n_risk * (n_risk - n_event)) ELSE 0 END)) AS rmst_se
  FROM (SELECT *, sum(surv * width) OVER (PARTITION BY strategy ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS tail FROM {prefix}_area) q GROUP BY strategy) y"""


_COX_NUM = ["log_hr", "hr", "se", "z", "p", "log_lower", "log_upper", "hr_lower", "hr_upper"]


def _cox_columns(fit: str) -> str:
    return f"""SELECT *, log_hr / se AS z, {_normal_tail("abs(log_hr / se)")} AS p, log_hr - 1.959963984540054::DOUBLE * se AS log_lower,
    log_hr + 1.959963984540054::DOUBLE * se AS log_upper, exp(log_hr - 1.959963984540054::DOUBLE * se) AS hr_lower,
    exp(log_hr + 1.959963984540054::DOUBLE * se) AS hr_upper FROM ({fit}) c"""


def _clone_hour_queries(name: str, counting: bool) -> None:
    """Curve, restricted mean, Cox and subgroup effects on clone-hours in one of the two readings."""
    rows = f"{name}_rows"
    start = "start" if counting else None
    curve_sql = _km_sql(rows, counting)
    cox_sql = _newton(f"SELECT *, 'all' AS everyone FROM {rows}", "everyone", prefix=f"cx_{name}", entry=counting)
    levels = " UNION ALL ".join(f"SELECT s.*, '{g}|' || f.{g} AS subgroup_level FROM {rows} s JOIN sub_flags f ON f.stay_id = s.stay_id" for g in panel.SUBGROUPS)
    cte(f"{name}_levels", levels)
    cte(f"{name}_large", f"SELECT * FROM {name}_levels WHERE subgroup_level IN (SELECT subgroup_level FROM {name}_levels WHERE w IS NOT NULL GROUP BY 1 HAVING count(*) >= 50)")
    level_sql = _newton(f"SELECT * FROM {name}_large", "subgroup_level", prefix=f"cx_{name}", entry=counting)

    def curve(spark: SparkSession, sf: str) -> DataFrame:
        _, _, hours = _hours(spark, sf, counting)
        return stage(survival.weighted_km(stage(hours, "clone-hours"), weight="ipcw_trunc", start=start), "curve")

    @query(f"km_{name}", oracle(f"SELECT * FROM {curve_sql}", num=list(_KM_COLUMNS[:5]), plain=list(_KM_COLUMNS[5:])))
    def km(spark: SparkSession, sf: str) -> DataFrame:
        return curve(spark, sf).select(*_KM_COLUMNS)

    @query(f"rmst_{name}", oracle(_rmst_sql(curve_sql), num=["rmst", "rmst_se", "rmtl"], plain=["strategy"]))
    def rmst_hours(spark: SparkSession, sf: str) -> DataFrame:
        return survival.rmst(curve(spark, sf)).select("rmst", "rmst_se", "rmtl", "strategy")

    @query(f"cox_{name}", oracle(_cox_columns(cox_sql), num=_COX_NUM))
    def cox(spark: SparkSession, sf: str) -> DataFrame:
        _, _, hours = _hours(spark, sf, counting)
        return survival.weighted_cox(stage(hours, "clone-hours"), weight="ipcw_trunc", start=start).select(*_COX_NUM)

    @query(f"subgroup_cox_{name}", oracle(f"""SELECT split_part(l.subgroup_level, '|', 1) AS subgroup, split_part(l.subgroup_level, '|', 2) AS level, z.hr, z.se
        FROM (SELECT DISTINCT subgroup_level FROM {name}_large) l LEFT JOIN ({level_sql}) z ON z.grp = l.subgroup_level""", num=["hr", "se"], plain=["subgroup", "level"]))
    def subgroups(spark: SparkSession, sf: str) -> DataFrame:
        s, cohort, hours = _hours(spark, sf, counting)
        flags = s.subgroups(stage(s.baseline(cohort), "baseline"), creat_stage="aki_stage_creat")
        both = left_join(hours, flags, "stay_id", list(panel.SUBGROUPS))
        return survival.subgroup_cox(both, panel.SUBGROUPS, weight="ipcw_trunc", start=start).select("hr", "se", "subgroup", "level")


_clone_hour_queries("hour", counting=False)
_clone_hour_queries("counting", counting=True)


# --- diagnostics -----------------------------------------------------------------------------

_DIAG = ", ".join(
    f"avg({c}) AS mean_{t}, stddev_samp({c}) AS sd_{t}, quantile_cont({c}, 0.5) AS p50_{t}, quantile_cont({c}, 0.95) AS p95_{t}, "
    f"quantile_cont({c}, 0.99) AS p99_{t}, max({c}) AS max_{t}"
    for c, t in (("ipcw", "raw"), ("ipcw_trunc", "trunc"))
)
_DIAG_NUM = [f"{k}_{t}" for t in ("raw", "trunc") for k in ("mean", "sd", "p50", "p95", "p99", "max")]


@query("weight_diag", oracle(f"SELECT count(*) AS n, {_DIAG} FROM trunc_rows WHERE ipcw IS NOT NULL", num=_DIAG_NUM, plain=["n"]))
def weight_diag(spark: SparkSession, sf: str) -> DataFrame:
    _, _, weighted = _weighted(spark, sf)
    return diagnostics.weight_summary(stage(weighted, "weighted"))


@query("weight_diag_report", oracle(f"SELECT count(*) AS n, {_DIAG} FROM trunc_rows WHERE ipcw IS NOT NULL", num=_DIAG_NUM, plain=["n"]))
def weight_diag_report(spark: SparkSession, sf: str) -> DataFrame:
    """The weight diagnostics as a CSV report, read back."""
    _, _, weighted = _weighted(spark, sf)
    return _report(spark, diagnostics.weight_summary(stage(weighted, "weighted")), "diagnostics")


@query("weight_six_numbers", oracle("""SELECT min(ipcw_trunc) AS min, quantile_cont(ipcw_trunc, 0.25) AS q1, quantile_cont(ipcw_trunc, 0.5) AS median, avg(ipcw_trunc) AS mean,
    quantile_cont(ipcw_trunc, 0.75) AS q3, max(ipcw_trunc) AS max, count(*) - count(ipcw_trunc) AS n_missing FROM trunc_rows""",
    num=["min", "q1", "median", "mean", "q3", "max"], plain=["n_missing"]))
def weight_six_numbers(spark: SparkSession, sf: str) -> DataFrame:
    _, _, weighted = _weighted(spark, sf)
    return diagnostics.six_number_summary(stage(weighted, "weighted"), "ipcw_trunc")


cte("w_long", "SELECT 'ipcw' AS type, ipcw AS weight FROM trunc_rows WHERE ipcw IS NOT NULL UNION ALL SELECT 'ipcw_trunc', ipcw_trunc FROM trunc_rows WHERE ipcw IS NOT NULL")


def _long(spark: SparkSession, sf: str) -> DataFrame:
    _, _, weighted = _weighted(spark, sf)
    return stage(diagnostics.weights_long(weighted), "weights-long")


@query("unpivot_weights", oracle("SELECT type, weight FROM w_long", num=["weight"], plain=["type"]))
def unpivot_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _long(spark, sf).select("weight", "type")


@query("weight_hist", oracle("""SELECT e.type, CAST(b AS INTEGER) AS bin, count(w.weight) AS n FROM (SELECT type, min(weight) AS lo, max(weight) AS hi FROM w_long GROUP BY type) e
    CROSS JOIN range(1, 101) r(b) LEFT JOIN w_long w ON w.type = e.type AND least(floor((w.weight - e.lo) / ((e.hi - e.lo) / 100)), 99) + 1 = b GROUP BY ALL""",
    plain=["type", "bin", "n"]))
def weight_hist(spark: SparkSession, sf: str) -> DataFrame:
    """Counts in 100 bins per type, empty bins included."""
    rounded = _long(spark, sf)
    return diagnostics.histogram(rounded, "weight", 100, ["type"]).select("type", "bin", "n")


@query("value_hist", oracle("""SELECT CAST(b AS INTEGER) AS bin, count(w.o_totalprice) AS n FROM (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) e
    CROSS JOIN range(1, 121) r(b) LEFT JOIN orders w ON least(floor((w.o_totalprice - e.lo) / ((e.hi - e.lo) / 120)), 119) + 1 = b GROUP BY ALL""",
    plain=["bin", "n"]))
def value_hist(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of one column in 120 bins."""
    return diagnostics.histogram(proxies.load(spark, sf, "orders"), "o_totalprice", 120).select("bin", "n")


@query("weight_ecdf", oracle("""SELECT type, weight, max(e) AS ecdf FROM (SELECT type, round(weight, 6) AS weight, cume_dist() OVER (PARTITION BY type ORDER BY weight) AS e FROM w_long) q
    GROUP BY type, weight""", num=["weight", "ecdf"], plain=["type"]))
def weight_ecdf(spark: SparkSession, sf: str) -> DataFrame:
    """Empirical distribution of raw and truncated weights, on weights shown to 6 places."""
    return (
        diagnostics.ecdf(_long(spark, sf))
        .groupBy("type", F.round("weight", 6).alias("weight"))
        .agg(F.max("ecdf").alias("ecdf"))
        .select("weight", "ecdf", "type")
    )


@query("weight_density", oracle("""SELECT c.type, CAST(i AS INTEGER) AS i, lo + (hi - lo) / 511 * i AS log10_weight,
    sum(c.n * exp(-power((lo + (hi - lo) / 511 * i - c.x) / bw, 2) / 2)) / (any_value(bw) * any_value(total) * sqrt(2 * pi())) AS density
    FROM (SELECT type, round(log10(weight), 3) AS x, count(*) AS n FROM w_long GROUP BY ALL) c
    JOIN (SELECT type, count(*) AS total, min(x) AS lo, max(x) AS hi,
      0.9 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) * power(count(*), -0.2) AS bw
      FROM (SELECT type, round(log10(weight), 3) AS x FROM w_long) z GROUP BY type) s ON s.type = c.type
    CROSS JOIN range(512) g(i) GROUP BY c.type, i, lo, hi""", num=["log10_weight", "density"], plain=["type", "i"]))
def weight_density(spark: SparkSession, sf: str) -> DataFrame:
    """Kernel density of log10 weights on 512 points per type."""
    return diagnostics.density(_long(spark, sf)).select("log10_weight", "density", "type", "i")


# --- pooled outcome model ---------------------------------------------------------------------

cte("person_days", """
SELECT s.*, CAST(d AS INTEGER) AS day, CASE WHEN event = 1 AND time <= d + 1 THEN 1 ELSE 0 END AS died
FROM surv_rows s CROSS JOIN range(28) r(d) WHERE w IS NOT NULL AND time > d""")

cte("day_hazard", "SELECT strategy, day, sum(w * died) / sum(w) AS hazard FROM person_days GROUP BY strategy, day")


@query("outcome_hazard", oracle("""SELECT strategy, day, hazard, product(1 - hazard) OVER (PARTITION BY strategy ORDER BY day ROWS UNBOUNDED PRECEDING) AS surv
    FROM day_hazard""", num=["hazard", "surv"], plain=["strategy", "day"]))
def outcome_hazard(spark: SparkSession, sf: str) -> DataFrame:
    """Discrete daily hazards of death by arm (saturated model) and their survival curve."""
    _, _, rows = _survival(spark, sf)
    days = pooled.person_periods(rows, 28, weight="ipcw_trunc_last")
    return pooled.curve(pooled.saturated_hazard(days)).select("hazard", "surv", "strategy", "day")


@query("outcome_hazard_contrast", oracle("""WITH c AS (SELECT strategy, day, product(1 - hazard) OVER (PARTITION BY strategy ORDER BY day ROWS UNBOUNDED PRECEDING) AS surv FROM day_hazard),
    m AS (SELECT strategy, min(surv) AS last, 1 + sum(CASE WHEN day < 27 THEN surv ELSE 0 END) AS rmst FROM c GROUP BY strategy)
    SELECT b.last - a.last AS risk_difference, (28 - a.rmst) - (28 - b.rmst) AS rmtl_difference FROM m a, m b WHERE a.strategy = 'A' AND b.strategy = 'B'""",
    num=["risk_difference", "rmtl_difference"]))
def outcome_hazard_contrast(spark: SparkSession, sf: str) -> DataFrame:
    """Risk difference and difference in time lost at 28 days from the discrete hazards."""
    _, _, rows = _survival(spark, sf)
    days = pooled.person_periods(rows, 28, weight="ipcw_trunc_last")
    return pooled.contrast(pooled.curve(pooled.saturated_hazard(days)), 28).select("risk_difference", "rmtl_difference")


cte("levels_day", """
SELECT day AS f, coalesce(sum(w) FILTER (strategy = 'B'), 0) AS n1, coalesce(sum(w) FILTER (strategy = 'A'), 0) AS n0,
  coalesce(sum(w * died) FILTER (strategy = 'B'), 0) AS y1, coalesce(sum(w * died) FILTER (strategy = 'A'), 0) AS y0
FROM person_days GROUP BY day""")
cte("arm_day_model", _newton_logit("day"))


@query("outcome_hazard_glm", oracle("""SELECT strategy, day, hazard, product(1 - hazard) OVER (PARTITION BY strategy ORDER BY day ROWS UNBOUNDED PRECEDING) AS surv
    FROM (SELECT c.strategy, c.day, CASE WHEN c.strategy = 'B' THEN m.p_b ELSE m.p_a END AS hazard
          FROM (SELECT DISTINCT strategy, day FROM person_days) c JOIN arm_day_model m ON m.f = c.day) q""", num=["hazard", "surv"], plain=["strategy", "day"]))
def outcome_hazard_glm(spark: SparkSession, sf: str) -> DataFrame:
    """Curves from the weighted pooled logistic outcome model: arm plus day."""
    _, _, rows = _survival(spark, sf)
    days = stage(pooled.person_periods(rows, 28, weight="ipcw_trunc_last"), "person-days")
    return pooled.curve(pooled.logistic_hazard(days, weight="w")).select("hazard", "surv", "strategy", "day")


@query("outcome_score_equations", oracle("""SELECT * FROM (SELECT day, strategy, round(sum(w * died), 3) AS expected FROM person_days
    GROUP BY GROUPING SETS ((day), (strategy))) q""", num=["expected"], plain=["day", "strategy"]))
def outcome_score_equations(spark: SparkSession, sf: str) -> DataFrame:
    """Expected weighted deaths of the pooled outcome model per day and per arm equal the observed ones."""
    _, _, rows = _survival(spark, sf)
    days = stage(pooled.person_periods(rows, 28, weight="ipcw_trunc_last"), "person-days")
    at_risk = days.groupBy("strategy", "day").agg(F.sum("w").alias("n"))
    both = pooled.logistic_hazard(days).join(at_risk, ["strategy", "day"])
    sums = both.cube("day", "strategy").agg(F.sum(F.col("n") * F.col("hazard")).alias("expected"))
    one = F.col("day").isNull() != F.col("strategy").isNull()
    return sums.filter(one).select((F.round("expected", 3) + 0.0).alias("expected"), "day", "strategy")
