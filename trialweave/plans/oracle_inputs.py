"""The proxy inputs and study stages again, as plain SQL with naive range joins.

Written independently of the Spark operators: correlated LATERAL lookups, row_number and
window functions in place of the aggregates, slice arithmetic and bucketed sums used there.
"""

from __future__ import annotations

from trialweave.plans.registry import cte

cte("ev", """
SELECT event_id, make_timestamp(opens + (epoch_us(ts) - opens) // 8) AS ts, user_id, user_id * 2 + part % 2 AS subject_id,
       event_type, value, user_id * 100 + part AS stay_id
FROM (SELECT *, epoch_us(TIMESTAMP '2024-01-01') + part * 1209600000000 AS opens
      FROM (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 14 AS part FROM events) w) m""")

cte("units", """
SELECT e.stay_id, e.user_id, e.subject_id, e.stay_id AS hadm_id, e.intime, e.outtime,
       CAST(10 + e.user_id % 80 AS DOUBLE) AS age,
       if(c.c_nationkey % 2 = 0, 'F', 'M') AS gender,
       'R' || CAST(c.c_nationkey % 5 AS VARCHAR) AS race,
       (epoch_us(e.outtime) - epoch_us(e.intime)) / 86400000000.0 AS los_icu
FROM (SELECT stay_id, user_id, subject_id, min(ts) AS intime, max(ts) AS outtime FROM ev GROUP BY stay_id, user_id, subject_id) e
LEFT JOIN customer c ON c.c_custkey = e.user_id""")

cte("adm", """
SELECT u.hadm_id, c.c_mktsegment AS insurance, u.intime - INTERVAL 24 HOUR AS admittime,
       CASE WHEN d.died >= u.intime THEN d.died END AS deathtime
FROM units u
LEFT JOIN (SELECT user_id, max(ts) AS died FROM ev WHERE event_type = 'signup' AND value > 100 GROUP BY user_id) d
  ON d.user_id = u.user_id
LEFT JOIN customer c ON c.c_custkey = u.user_id""")

cte("infection", """
SELECT stay_id, min(ts) AS suspected_infection_time, stay_id % 11 <> 0 AS sepsis3
FROM ev WHERE event_type <> 'error' GROUP BY stay_id""")

cte("wt", """
SELECT stay_id, intime - INTERVAL 1 HOUR AS starttime,
       CASE WHEN subject_id % 7 <> 0 THEN outtime END AS endtime,
       CASE WHEN subject_id % 23 <> 0 THEN CAST(50 + subject_id % 60 AS DOUBLE) END AS weight
FROM units""")

cte("icd", """
SELECT o_custkey AS subject_id,
       CASE o_orderstatus WHEN 'P' THEN 10 WHEN 'F' THEN 9 END AS icd_version,
       o_orderpriority || '/' || CAST(o_orderkey % 16 AS VARCHAR) AS icd_code
FROM orders""")

cte("stg", """
SELECT stay_id, CASE WHEN event_id % 37 <> 0 THEN ts END AS charttime, event_id, CAST(1 + event_id % 3 AS INTEGER) AS aki_stage,
       CAST(1 + (event_id // 3) % 3 AS INTEGER) AS aki_stage_creat
FROM ev WHERE event_type = 'error'""")

cte("drug", """
SELECT stay_id, CASE WHEN event_id % 41 <> 0 THEN ts - INTERVAL 1 HOUR END AS starttime, event_id,
       CASE WHEN event_id % 10 <> 0 THEN ts + to_seconds(CAST(round(value * 1200) AS BIGINT)) END AS endtime,
       CASE WHEN event_id % 12 <> 0 THEN value / 100 END AS dose,
       CASE WHEN event_id % 8 = 4 THEN value / 50 END AS vasopressin
FROM ev WHERE event_type <> 'error'""")

cte("drug_on", "SELECT * FROM drug WHERE coalesce(dose, 0) > 0 OR coalesce(vasopressin, 0) > 0")

cte("vent", """
SELECT stay_id, CASE WHEN event_id % 41 <> 0 THEN ts END AS starttime, ts + to_seconds(CAST(round(value * 300) AS BIGINT)) AS endtime
FROM ev WHERE event_type = 'view' AND event_id % 2 = 0""")

cte("rrt", """
SELECT stay_id, CASE WHEN event_id % 37 <> 0 THEN ts END AS charttime, CASE WHEN event_id % 20 = 0 THEN 1 END AS dialysis_present,
       CASE WHEN event_id % 22 = 0 THEN 1 ELSE 0 END AS dialysis_active
FROM ev WHERE event_type = 'purchase'""")

cte("crrt", """
SELECT stay_id, CASE WHEN event_id % 37 <> 0 THEN ts END AS charttime, event_id, CAST(event_id % 14 = 1 AS INTEGER) AS system_active,
       CASE WHEN event_id % 18 = 0 THEN 'CVVH' END AS crrt_mode
FROM ev WHERE event_type = 'purchase'""")

cte("vital", """
SELECT stay_id, CASE WHEN event_id % 37 <> 0 THEN ts END AS charttime, event_id, 60 + value / 10 AS hr, 100 + value / 5 AS sbp, 50 + value / 8 AS dbp,
       CASE WHEN event_id % 15 <> 0 THEN 40 + value END AS mbp, 10 + value / 20 AS rr,
       CASE WHEN event_id % 3 <> 0 THEN 90 + value / 100 END AS spo2, 36 + value / 200 AS temp_c
FROM ev""")

cte("lab", """
SELECT stay_id AS hadm_id, CASE WHEN event_id % 37 <> 0 THEN ts END AS charttime, event_id, 130 + value / 50 AS na, 95 + value / 40 AS cl,
       3 + event_id * 3 % 23 / 10.0::DOUBLE AS k, CASE WHEN event_id % 7 <> 0 THEN 20 + value / 20 END AS hco3, 1 + value / 50 AS scr,
       10 + value / 4 AS bun, 7 + event_id * 5 % 11 / 20.0::DOUBLE AS ph, CASE WHEN event_id % 18 <> 0 THEN event_id * 7 % 50 / 5.0::DOUBLE END AS lactate,
       40 + value AS pao2, CASE WHEN event_id % 27 <> 0 THEN CAST(event_id % 16 AS DOUBLE) / 20 END AS fio2
FROM ev WHERE event_type IN ('view', 'error', 'signup')""")

cte("urine", "SELECT stay_id, CASE WHEN event_id % 37 <> 0 THEN ts END AS charttime, 10 * value AS urineoutput FROM ev WHERE event_type IN ('purchase', 'signup')")

# --- cohort stages --------------------------------------------------------------------------

cte("core", """
SELECT f.stay_id, f.subject_id, f.hadm_id, f.intime, f.outtime, f.age, f.gender, f.race, a.insurance, f.los_icu
FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY intime NULLS LAST, stay_id) AS rn FROM units) f
JOIN infection s ON s.stay_id = f.stay_id
LEFT JOIN adm a ON a.hadm_id = f.hadm_id
WHERE f.rn = 1 AND f.age >= 18 AND f.los_icu >= 1.0 AND s.sepsis3 IS TRUE
  AND s.suspected_infection_time >= f.intime AND s.suspected_infection_time <= f.outtime
  AND f.stay_id IN (SELECT stay_id FROM wt WHERE weight IS NOT NULL)
  AND f.subject_id NOT IN (SELECT subject_id FROM icd
      WHERE (icd_version = 10 AND icd_code = '1-URGENT/0') OR (icd_version = 9 AND icd_code IN ('2-HIGH/1', '5-LOW/2')))""")

cte("first3", "SELECT stay_id, min(charttime) AS kdigo3_time FROM stg WHERE aki_stage = 3 AND charttime IS NOT NULL GROUP BY stay_id")

cte("t_zero", """
SELECT c.*, k.kdigo3_time, greatest(c.intime, k.kdigo3_time - INTERVAL 6 HOUR) AS t0_time
FROM core c JOIN first3 k ON k.stay_id = c.stay_id""")

cte("screened", """
SELECT t.*,
  EXISTS (SELECT 1 FROM infection s WHERE s.stay_id = t.stay_id AND s.sepsis3 IS TRUE
          AND s.suspected_infection_time <= t.t0_time) AS infected,
  EXISTS (SELECT 1 FROM drug_on v WHERE v.stay_id = t.stay_id AND v.starttime < t.t0_time
          AND coalesce(v.endtime, t.t0_time) > t.t0_time - INTERVAL 6 HOUR) AS on_drug,
  EXISTS (SELECT 1 FROM rrt r WHERE r.stay_id = t.stay_id AND r.charttime < t.t0_time
          AND (r.dialysis_present = 1 OR r.dialysis_active = 1))
  OR EXISTS (SELECT 1 FROM crrt r WHERE r.stay_id = t.stay_id AND r.charttime < t.t0_time
          AND (r.system_active = 1 OR r.crrt_mode IS NOT NULL)) AS treated
FROM t_zero t""")

cte("index_cohort", "SELECT * FROM screened WHERE infected AND on_drug AND NOT treated")

# Relaxed cohort: every unit with a time zero.
cte("coh", """
SELECT u.*, a.insurance, k.kdigo3_time, greatest(u.intime, k.kdigo3_time - INTERVAL 6 HOUR) AS t0_time
FROM units u JOIN first3 k ON k.stay_id = u.stay_id LEFT JOIN adm a ON a.hadm_id = u.hadm_id""")

cte("wt_t0", """
SELECT c.stay_id, w.weight AS weight_kg FROM coh c LEFT JOIN LATERAL (
  SELECT weight FROM wt WHERE wt.stay_id = c.stay_id AND wt.starttime <= c.t0_time
    AND coalesce(wt.endtime, c.t0_time) >= c.t0_time AND wt.weight IS NOT NULL
  ORDER BY wt.starttime DESC LIMIT 1) w ON true""")

cte("treat", """
SELECT c.stay_id, min(x.charttime) AS crrt_start_time FROM coh c JOIN crrt x ON x.stay_id = c.stay_id
WHERE x.charttime >= c.t0_time AND (x.system_active = 1 OR x.crrt_mode IS NOT NULL) GROUP BY c.stay_id""")

cte("lab_t0", """
SELECT c.stay_id, l.* EXCLUDE (hadm_id, charttime, event_id) FROM coh c LEFT JOIN LATERAL (
  SELECT * FROM lab WHERE lab.hadm_id = c.hadm_id AND lab.charttime > c.t0_time - INTERVAL 6 HOUR
    AND lab.charttime <= c.t0_time ORDER BY lab.charttime DESC, lab.event_id DESC LIMIT 1) l ON true""")

cte("vital_t0", """
SELECT c.stay_id, l.* EXCLUDE (stay_id, charttime, event_id) FROM coh c LEFT JOIN LATERAL (
  SELECT * FROM vital WHERE vital.stay_id = c.stay_id AND vital.charttime > c.t0_time - INTERVAL 6 HOUR
    AND vital.charttime <= c.t0_time ORDER BY vital.charttime DESC, vital.event_id DESC LIMIT 1) l ON true""")

cte("dose_t0", """
SELECT c.stay_id, d.dose AS ne_eq_baseline FROM coh c LEFT JOIN LATERAL (
  SELECT dose FROM drug WHERE drug.stay_id = c.stay_id AND drug.starttime < c.t0_time
    AND coalesce(drug.endtime, c.t0_time) > c.t0_time - INTERVAL 6 HOUR AND drug.dose IS NOT NULL
  ORDER BY drug.endtime DESC NULLS FIRST, drug.event_id DESC LIMIT 1) d ON true""")

cte("flags_t0", """
SELECT c.stay_id,
  CASE WHEN EXISTS (SELECT 1 FROM vent v WHERE v.stay_id = c.stay_id AND v.starttime < c.t0_time
    AND coalesce(v.endtime, c.t0_time) > c.t0_time - INTERVAL 6 HOUR) THEN 1 ELSE 0 END AS mv_baseline,
  CASE WHEN EXISTS (SELECT 1 FROM drug_on v WHERE v.stay_id = c.stay_id AND v.starttime < c.t0_time
    AND coalesce(v.endtime, c.t0_time) > c.t0_time - INTERVAL 6 HOUR) THEN 1 ELSE 0 END AS vaso_baseline
FROM coh c""")

cte("base", """
SELECT c.subject_id, c.hadm_id, c.stay_id, c.intime, c.outtime, c.t0_time, c.age, c.gender, c.race, c.insurance,
  c.los_icu, w.weight_kg, CAST(c.subject_id % 10 AS INTEGER) AS cci, v.hr, v.sbp, v.dbp, v.mbp AS map, v.rr, v.spo2, v.temp_c,
  b.wbc, b.hb, b.plt, l.na, l.cl, l.k, l.hco3, l.scr, l.bun, e.ast, e.alt, l.ph, l.lactate, l.pao2, l.fio2,
  CASE WHEN l.pao2 IS NOT NULL AND l.fio2 > 0 THEN l.pao2 / l.fio2 END AS pf_ratio,
  g.inr, f.mv_baseline, f.vaso_baseline, d.ne_eq_baseline, s.sofa_baseline
FROM coh c
JOIN wt_t0 w ON w.stay_id = c.stay_id JOIN vital_t0 v ON v.stay_id = c.stay_id
JOIN lab_t0 l ON l.stay_id = c.stay_id JOIN dose_t0 d ON d.stay_id = c.stay_id
JOIN flags_t0 f ON f.stay_id = c.stay_id
LEFT JOIN LATERAL (SELECT value / 10 AS wbc, 8 + value / 50 AS hb, 100 + value AS plt FROM ev
  WHERE ev.stay_id = c.stay_id AND event_type IN ('signup', 'error') AND event_id % 37 <> 0 AND ts > c.t0_time - INTERVAL 6 HOUR
    AND ts <= c.t0_time ORDER BY ts DESC, event_id DESC LIMIT 1) b ON true
LEFT JOIN LATERAL (SELECT value AS ast, value / 2 AS alt FROM ev WHERE ev.stay_id = c.stay_id AND event_type = 'signup'
    AND event_id % 37 <> 0 AND ts > c.t0_time - INTERVAL 6 HOUR AND ts <= c.t0_time ORDER BY ts DESC, event_id DESC LIMIT 1) e ON true
LEFT JOIN LATERAL (SELECT 1 + value / 100 AS inr FROM ev WHERE ev.stay_id = c.stay_id AND event_type = 'purchase'
    AND event_id % 37 <> 0 AND ts > c.t0_time - INTERVAL 6 HOUR AND ts <= c.t0_time ORDER BY ts DESC, event_id DESC LIMIT 1) g ON true
LEFT JOIN LATERAL (SELECT CAST(event_id % 20 AS INTEGER) AS sofa_baseline FROM ev WHERE ev.stay_id = c.stay_id
    AND event_type = 'error' AND event_id % 9 <> 0 AND ts > c.t0_time - INTERVAL 6 HOUR AND ts <= c.t0_time
  ORDER BY ts DESC, event_id DESC LIMIT 1) s ON true""")

# Bands as half-open ranges.
cte("bands", """
SELECT * FROM (VALUES
  ('urine', -1e9, 0.3, 'oliguria_<0.3'), ('urine', 0.3, 0.5, 'oliguria_0.3-0.5'), ('urine', 0.5, 1e9, 'non_oliguric_>=0.5'),
  ('dose', -1e9, 0.1, 'NE_<0.1'), ('dose', 0.1, 0.3, 'NE_0.1-0.3'), ('dose', 0.3, 1e9, 'NE_>=0.3'),
  ('lactate', -1e9, 4, 'lactate_<4'), ('lactate', 4, 1e9, 'lactate_>=4'),
  ('pf', -1e9, 100, 'PF_<100'), ('pf', 100, 200, 'PF_100-200'), ('pf', 200, 1e9, 'PF_>=200')) v(kind, lo, hi, label)""")


def _label(kind: str, value: str) -> str:
    return (
        f"coalesce((SELECT any_value(label) FROM bands WHERE kind = '{kind}' AND q.{value} >= bands.lo AND q.{value} < bands.hi), 'missing')"
    )


cte("sub_flags", f"""
SELECT q.*, {_label('urine', 'uo_mlkgph_t0_last6h')} AS oliguria_3grp, {_label('dose', 'ne_ugkgmin')} AS ne_3grp,
  if(mv_flag = 1, 'MV', 'no_MV') AS mv_2grp, {_label('lactate', 'lactate_mmol')} AS lactate_2grp,
  {_label('pf', 'pf_ratio')} AS pf_3grp,
  (['unknown', 'uo_driven', 'scr_driven', 'mixed'])[1 + CAST(coalesce(aki_stage_uo_t0 = 3, false) AS INTEGER)
    + 2 * CAST(coalesce(aki_stage_creat_t0 = 3, false) AS INTEGER)] AS aki_pathway
FROM (
  SELECT b.subject_id, b.hadm_id, b.stay_id, b.t0_time, if(b.weight_kg > 0, u.total / b.weight_kg / 6.0, NULL) AS uo_mlkgph_t0_last6h,
    b.ne_eq_baseline AS ne_ugkgmin, b.mv_baseline AS mv_flag, b.lactate AS lactate_mmol, b.pf_ratio,
    k.aki_stage AS aki_stage_uo_t0, k.aki_stage_creat AS aki_stage_creat_t0
  FROM base b
  LEFT JOIN (SELECT b.stay_id, sum(urineoutput) AS total FROM base b JOIN urine ON urine.stay_id = b.stay_id
    AND charttime > b.t0_time - INTERVAL 6 HOUR AND charttime <= b.t0_time GROUP BY b.stay_id) u ON u.stay_id = b.stay_id
  LEFT JOIN (SELECT b.stay_id, arg_max(struct_pack(aki_stage, aki_stage_creat), (charttime, event_id)) AS v FROM base b
    JOIN stg ON stg.stay_id = b.stay_id AND charttime <= b.t0_time GROUP BY b.stay_id) n ON n.stay_id = b.stay_id
  LEFT JOIN LATERAL (SELECT n.v.aki_stage AS aki_stage, n.v.aki_stage_creat AS aki_stage_creat) k ON true) q""")

# --- hourly panel, clones, outcomes ---------------------------------------------------------

for _hours in (12, 24, 36):
    cte(f"grid_{_hours}", f"""
SELECT c.subject_id, c.hadm_id, c.stay_id, c.t0_time, CAST(h AS INTEGER) AS hour_index,
       c.t0_time + to_hours(CAST(h AS INTEGER)) AS t_start, c.t0_time + to_hours(CAST(h + 1 AS INTEGER)) AS t_end
FROM coh c CROSS JOIN range({_hours}) r(h)""")

    cte(f"panel_{_hours}", f"""
SELECT h.*, t.crrt_start_time,
  CASE WHEN w.weight_kg > 0 THEN coalesce((SELECT sum(u.urineoutput) FROM urine u WHERE u.stay_id = h.stay_id
    AND u.charttime > h.t_end - INTERVAL 6 HOUR AND u.charttime <= h.t_end), 0) / w.weight_kg / 6.0 END AS uo_mlkgph_last6h,
  v.mbp AS map_last1h,
  CASE WHEN EXISTS (SELECT 1 FROM drug_on d WHERE d.stay_id = h.stay_id AND d.starttime < h.t_end
    AND coalesce(d.endtime, h.t_end) > h.t_end - INTERVAL 1 HOUR) THEN 1 ELSE 0 END AS vaso_flag_last1h,
  (SELECT max(d.dose) FROM drug d WHERE d.stay_id = h.stay_id AND d.starttime < h.t_end
    AND coalesce(d.endtime, h.t_end) > h.t_end - INTERVAL 1 HOUR) AS ne_eq_last1h,
  CASE WHEN EXISTS (SELECT 1 FROM vent d WHERE d.stay_id = h.stay_id AND d.starttime < h.t_end
    AND coalesce(d.endtime, h.t_end) > h.t_end - INTERVAL 1 HOUR) THEN 1 ELSE 0 END AS mv_flag_last1h,
  l.lactate AS lactate_last6h, l.ph AS ph_last6h, l.k AS k_last6h, l.hco3 AS hco3_last6h, l.scr AS scr_last6h
FROM grid_{_hours} h
LEFT JOIN wt_t0 w ON w.stay_id = h.stay_id
LEFT JOIN treat t ON t.stay_id = h.stay_id
LEFT JOIN LATERAL (SELECT mbp FROM vital WHERE vital.stay_id = h.stay_id AND vital.charttime > h.t_end - INTERVAL 1 HOUR
  AND vital.charttime <= h.t_end AND vital.mbp IS NOT NULL ORDER BY vital.charttime DESC, vital.event_id DESC LIMIT 1) v ON true
LEFT JOIN LATERAL (SELECT lactate, ph, k, hco3, scr FROM lab WHERE lab.hadm_id = h.hadm_id
  AND lab.charttime > h.t_end - INTERVAL 6 HOUR AND lab.charttime <= h.t_end
  ORDER BY lab.charttime DESC, lab.event_id DESC LIMIT 1) l ON true""")


def _clones(rows: str, grace: int) -> str:
    g = f"(x.t0_time + INTERVAL {grace} HOUR)"
    return f"""
SELECT z.*,
  CAST(coalesce(admin_censor_time <= coalesce(proto_censor_time, 'infinity'), false) AS INTEGER) AS admin_censor_driving,
  CAST(coalesce(proto_censor_time < coalesce(admin_censor_time, 'infinity'), false) AS INTEGER) AS proto_censor_driving,
  CAST(coalesce(t_start < total_censor_time AND t_end >= total_censor_time, false) AS INTEGER) AS censor_k_total,
  CAST(coalesce(total_censor_time, 'infinity') > t_end AS INTEGER) AS at_risk_after_k,
  CAST(strategy = 'A' AND started_early AS INTEGER) AS task_completed_within_24h,
  CAST(strategy = 'B' AND NOT started_early AS INTEGER) AS task_maintained_no_early_24h
FROM (
  SELECT y.*, least(proto_censor_time, admin_censor_time) AS total_censor_time FROM (
    SELECT x.*, s.strategy, a.deathtime AS death_time, c.outtime AS icu_outtime, {g} AS grace_end,
      coalesce(x.crrt_start_time, 'infinity') < {g} AS started_early,
      if(s.strategy = 'A', if(started_early, NULL, {g}), if(started_early, x.crrt_start_time, NULL)) AS proto_censor_time,
      coalesce(if(a.deathtime > x.t0_time AND a.deathtime < {g}, a.deathtime, NULL),
               if(c.outtime > x.t0_time AND c.outtime < {g}, c.outtime, NULL)) AS admin_censor_time
    FROM ({rows}) x
    JOIN coh c ON c.stay_id = x.stay_id LEFT JOIN adm a ON a.hadm_id = x.hadm_id
    CROSS JOIN (VALUES ('A'), ('B')) s(strategy)) y) z"""


_BARE = "SELECT h.*, t.crrt_start_time FROM grid_{0} h LEFT JOIN treat t ON t.stay_id = h.stay_id"
cte("clone_bare", _clones(_BARE.format(24), 24))
cte("clone_bare_12", _clones(_BARE.format(12), 12))
cte("clone_full", _clones("SELECT * FROM panel_24", 24))

# Only the two flags that the saturated weight models read.
cte("panel_flags", """
SELECT h.*, t.crrt_start_time,
  CASE WHEN EXISTS (SELECT 1 FROM drug_on d WHERE d.stay_id = h.stay_id AND d.starttime < h.t_end
    AND coalesce(d.endtime, h.t_end) > h.t_end - INTERVAL 1 HOUR) THEN 1 ELSE 0 END AS vaso_flag_last1h,
  CASE WHEN EXISTS (SELECT 1 FROM vent d WHERE d.stay_id = h.stay_id AND d.starttime < h.t_end
    AND coalesce(d.endtime, h.t_end) > h.t_end - INTERVAL 1 HOUR) THEN 1 ELSE 0 END AS mv_flag_last1h
FROM grid_24 h LEFT JOIN treat t ON t.stay_id = h.stay_id""")
cte("clone_flags", _clones("SELECT * FROM panel_flags", 24))

cte("outc", """
SELECT q.*, CAST(dies > t0_time AND dies <= t0_time + INTERVAL 7 DAY AS INTEGER) AS death_7d,
  CAST(dies > t0_time + INTERVAL 7 DAY AS INTEGER) AS alive_7d,
  CAST(dies > t0_time AND dies <= t0_time + INTERVAL 28 DAY AS INTEGER) AS death_28d,
  CAST(dies > t0_time + INTERVAL 28 DAY AS INTEGER) AS alive_28d
FROM (
  SELECT c.subject_id, c.hadm_id, c.stay_id, c.t0_time, any_value(a.deathtime) AS deathtime,
    coalesce(any_value(a.deathtime), 'infinity') AS dies,
    min(l.scr) FILTER (WHERE l.charttime BETWEEN a.admittime AND c.t0_time) AS scr_baseline,
    min(l.scr) FILTER (WHERE l.charttime BETWEEN c.t0_time - INTERVAL 7 DAY AND c.t0_time) AS scr_baseline_7d,
    arg_max(l.scr, (l.charttime, l.event_id)) FILTER (WHERE l.charttime > c.t0_time AND l.charttime <= c.t0_time + INTERVAL 28 DAY) AS scr_28d
  FROM coh c JOIN adm a ON a.hadm_id = c.hadm_id LEFT JOIN lab l ON l.hadm_id = c.hadm_id
  GROUP BY c.subject_id, c.hadm_id, c.stay_id, c.t0_time) q""")

# --- saturated weights and survival ---------------------------------------------------------

cte("risk_rows", "SELECT * FROM clone_flags WHERE total_censor_time IS NULL OR total_censor_time > t_start")

cte("hazards", """
SELECT r.*, avg(censor_k_total) OVER (PARTITION BY strategy, hour_index) AS p_num,
       avg(censor_k_total) OVER (PARTITION BY strategy, hour_index, vaso_flag_last1h, mv_flag_last1h) AS p_denom
FROM risk_rows r""")

cte("wslice", """
SELECT h.*, CASE WHEN p_denom < 1 AND p_num < 1 THEN (1 - p_num) / (1 - p_denom) END AS w_slice,
       CASE WHEN p_denom < 1 AND p_num < 1 THEN (1 - p_denom) / (1 - p_num) END AS w_coded
FROM hazards h""")

cte("ipcw_rows", """
SELECT s.*,
  CASE WHEN bool_or(w_slice IS NULL) OVER w THEN NULL ELSE product(w_slice) OVER w END AS ipcw,
  CASE WHEN bool_or(w_coded IS NULL) OVER w THEN NULL ELSE product(w_coded) OVER w END AS ipcw_coded
FROM wslice s
WINDOW w AS (PARTITION BY stay_id, strategy ORDER BY hour_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")

cte("trunc_rows", """
SELECT r.*, CASE WHEN ipcw IS NOT NULL THEN least(greatest(ipcw, b.lo), b.hi) END AS ipcw_trunc
FROM ipcw_rows r CROSS JOIN (SELECT quantile_cont(ipcw, 0.01) AS lo, quantile_cont(ipcw, 0.99) AS hi FROM ipcw_rows) b""")

cte("clone_w", """
SELECT stay_id, strategy, ipcw_trunc AS w FROM (
  SELECT *, row_number() OVER (PARTITION BY stay_id, strategy ORDER BY hour_index DESC) AS rn
  FROM trunc_rows WHERE at_risk_after_k = 1) q WHERE rn = 1""")

cte("surv_rows", """
SELECT c.stay_id, c.strategy, c.w, o.deathtime, o.t0_time,
  CASE WHEN o.deathtime IS NULL THEN 28.0::DOUBLE
       ELSE least((epoch_us(o.deathtime) - epoch_us(o.t0_time)) / 86400000000.0::DOUBLE, 28.0::DOUBLE) END AS time,
  o.death_28d AS event
FROM clone_w c JOIN outc o ON o.stay_id = c.stay_id
WHERE o.deathtime IS NULL OR o.deathtime > o.t0_time""")

cte("km_steps", """
SELECT strategy, time, sum(w) AS w, sum(w * event) AS n_event, count(*) AS n, sum(event) AS count_event
FROM surv_rows WHERE w IS NOT NULL GROUP BY strategy, time""")

cte("km_rows", """
SELECT strategy, time, CAST(count_event AS BIGINT) AS count_event, n_event, n_risk, CAST(count_risk AS BIGINT) AS count_risk,
  product(CASE WHEN n_event >= n_risk THEN 0.0 ELSE 1 - n_event / n_risk END) OVER up AS surv,
  sqrt(sum(CASE WHEN n_event > 0 AND n_event < n_risk THEN n_event / (n_risk * (n_risk - n_event)) ELSE 0 END) OVER up) AS std_err
FROM (SELECT *, sum(w) OVER down AS n_risk, sum(n) OVER down AS count_risk FROM km_steps
      WINDOW down AS (PARTITION BY strategy ORDER BY time DESC ROWS UNBOUNDED PRECEDING)) q
WINDOW up AS (PARTITION BY strategy ORDER BY time ROWS UNBOUNDED PRECEDING)""")

cte("km_grid", """
SELECT g.strategy, g.time, coalesce(k.surv, 1.0) AS surv FROM
  (SELECT s.strategy, CAST(i AS DOUBLE) / 2 AS time, s.reach FROM range(57) r(i)
   CROSS JOIN (SELECT strategy, max(time) AS reach FROM km_rows GROUP BY strategy) s) g
LEFT JOIN LATERAL (SELECT surv FROM km_rows WHERE km_rows.strategy = g.strategy AND km_rows.time <= g.time
  ORDER BY km_rows.time DESC LIMIT 1) k ON true
WHERE g.time <= g.reach""")
