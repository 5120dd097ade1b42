"""Queries for as-of, interval and slice lookups over the relaxed proxy cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.functions.exprs import plus_hours
from trialweave.operators import joins, lookups
from trialweave.plans import oracle_inputs, proxies  # noqa: F401
from trialweave.plans.registry import oracle, query
from trialweave.plans.study import Study

_BEFORE = "lab.charttime > c.t0_time - INTERVAL 6 HOUR AND lab.charttime <= c.t0_time"


def _cohort(spark: SparkSession, sf: str) -> tuple[Study, DataFrame]:
    s = proxies.study(spark, sf)
    return s, proxies.relaxed_cohort(s).select("stay_id", "subject_id", "hadm_id", "t0_time")


def _at_t0(spark: SparkSession, sf: str, make, *cols: str) -> DataFrame:
    s, units = _cohort(spark, sf)
    return lookups.gather(units, "stay_id", "t0_time", [make(s)]).select("stay_id", *cols)


@query("has_event_before", oracle("""SELECT c.stay_id FROM coh c WHERE EXISTS (SELECT 1 FROM infection s WHERE s.stay_id = c.stay_id
    AND s.sepsis3 IS TRUE AND s.suspected_infection_time <= c.t0_time)""", plain=["stay_id"]))
def has_event_before(spark: SparkSession, sf: str) -> DataFrame:
    """EXISTS with a time bound, as an equi-join to the earliest event."""
    s, units = _cohort(spark, sf)
    confirmed = s.tables["sepsis3"].filter(F.col("sepsis3").eqNullSafe(True))
    return joins.has_event(units, confirmed, "stay_id", "suspected_infection_time", "t0_time").select("stay_id")


@query("no_event_before", oracle("""SELECT c.stay_id FROM coh c WHERE NOT EXISTS (SELECT 1 FROM crrt r WHERE r.stay_id = c.stay_id
    AND r.charttime < c.t0_time AND (r.system_active = 1 OR r.crrt_mode IS NOT NULL))""", plain=["stay_id"]))
def no_event_before(spark: SparkSession, sf: str) -> DataFrame:
    s, units = _cohort(spark, sf)
    return joins.no_event_before(units, s.tables["crrt"].filter(s.on_device()), "stay_id", "charttime", "t0_time").select("stay_id")


@query("overlap_flag", oracle("SELECT stay_id, vaso_baseline, mv_baseline FROM flags_t0", plain=["stay_id", "vaso_baseline", "mv_baseline"]))
def overlap_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Interval overlap with the window before t0, open intervals ongoing."""
    s, units = _cohort(spark, sf)
    both = [s.drug_overlap("vaso_baseline", 6), s.ventilated("mv_baseline", 6)]
    return lookups.gather(units, "stay_id", "t0_time", both).select("stay_id", "vaso_baseline", "mv_baseline")


@query("asof_last_6h", oracle(f"""SELECT c.stay_id, l.lactate, l.fio2, l.scr FROM coh c LEFT JOIN LATERAL (SELECT * FROM lab
    WHERE lab.hadm_id = c.hadm_id AND {_BEFORE} ORDER BY lab.charttime DESC, lab.event_id DESC LIMIT 1) l ON true""",
    num=["lactate", "fio2"], plain=["stay_id"]))
def asof_last_6h(spark: SparkSession, sf: str) -> DataFrame:
    """Newest row in (t0 - 6 h, t0], taken whole."""
    return _at_t0(
        spark, sf,
        lambda s: lookups.last(s.tables["bg"], "hadm_id", "charttime", ["lactate", "fio2"], 6, tiebreak=("event_id",)),
        "lactate", "fio2",
    )


@query("asof_not_null", oracle(f"""SELECT c.stay_id, l.lactate FROM coh c LEFT JOIN LATERAL (SELECT lactate FROM lab
    WHERE lab.hadm_id = c.hadm_id AND {_BEFORE} AND lactate IS NOT NULL ORDER BY lab.charttime DESC, lab.event_id DESC LIMIT 1) l ON true""",
    num=["lactate"], plain=["stay_id"]))
def asof_not_null(spark: SparkSession, sf: str) -> DataFrame:
    """Newest row that holds a value."""
    return _at_t0(
        spark, sf,
        lambda s: lookups.last(s.tables["bg"], "hadm_id", "charttime", "lactate", 6, "lactate", ("event_id",)),
        "lactate",
    )


@query("asof_ahead_28d", oracle("SELECT stay_id, scr_28d FROM outc", num=["scr_28d"], plain=["stay_id"]))
def asof_ahead_28d(spark: SparkSession, sf: str) -> DataFrame:
    """Newest value in (t0, t0 + 28 d]."""
    return _at_t0(
        spark, sf,
        lambda s: lookups.last_ahead(
            s.tables["chemistry"], "hadm_id", "charttime", {"scr_28d": "creatinine"}, 24 * 28, "creatinine", ("event_id",)
        ),
        "scr_28d",
    )


@query("asof_unbounded", oracle("""SELECT c.stay_id, k.aki_stage FROM coh c LEFT JOIN LATERAL (SELECT aki_stage FROM stg WHERE stg.stay_id = c.stay_id
    AND stg.charttime <= c.t0_time ORDER BY stg.charttime DESC, stg.event_id DESC LIMIT 1) k ON true""", plain=["stay_id", "aki_stage"]))
def asof_unbounded(spark: SparkSession, sf: str) -> DataFrame:
    return _at_t0(
        spark, sf,
        lambda s: lookups.last(s.tables["kdigo_stages"], "stay_id", "charttime", "aki_stage", None, tiebreak=("event_id",)),
        "aki_stage",
    )


@query("valid_at", oracle("SELECT stay_id, weight_kg FROM wt_t0", num=["weight_kg"], plain=["stay_id"]))
def valid_at(spark: SparkSession, sf: str) -> DataFrame:
    """Interval that contains t0, both ends included, open end still valid."""
    return _at_t0(spark, sf, lambda s: s.weight(), "weight_kg")


@query("overlap_last_open_first", oracle("SELECT stay_id, ne_eq_baseline FROM dose_t0", num=["ne_eq_baseline"], plain=["stay_id"]))
def overlap_last_open_first(spark: SparkSession, sf: str) -> DataFrame:
    """Dose of the overlapping interval that ends last; an open one ends last of all."""
    dose = "norepinephrine_equivalent_dose"
    return _at_t0(
        spark, sf,
        lambda s: lookups.overlap_last(
            s.tables[dose], "stay_id", "starttime", "endtime", {"ne_eq_baseline": dose}, 6, dose, ("event_id",)
        ),
        "ne_eq_baseline",
    )


def _urine_sql(empty: str) -> str:
    return oracle(f"""SELECT c.stay_id, {empty} AS total FROM coh c LEFT JOIN (SELECT c.stay_id, sum(u.urineoutput) AS s FROM coh c
        JOIN urine u ON u.stay_id = c.stay_id AND u.charttime > c.t0_time - INTERVAL 6 HOUR AND u.charttime <= c.t0_time GROUP BY c.stay_id) q
        ON q.stay_id = c.stay_id""", num=["total"], plain=["stay_id"])


@query("window_sum_null", _urine_sql("q.s"))
def window_sum_null(spark: SparkSession, sf: str) -> DataFrame:
    """Sum over a window, NULL where no row qualifies."""
    return _at_t0(
        spark, sf, lambda s: lookups.window_value(s.tables["urine_output"], "stay_id", "charttime", "urineoutput", "total", "sum", 6), "total"
    )


@query("window_sum_zero", _urine_sql("coalesce(q.s, 0)"))
def window_sum_zero(spark: SparkSession, sf: str) -> DataFrame:
    """Sum over a window, 0 where no row qualifies."""
    return _at_t0(
        spark, sf,
        lambda s: lookups.window_value(s.tables["urine_output"], "stay_id", "charttime", "urineoutput", "total", "sum", 6, empty=0.0),
        "total",
    )


@query("window_max", oracle(f"""SELECT c.stay_id, (SELECT max(lactate) FROM lab WHERE lab.hadm_id = c.hadm_id AND {_BEFORE}) AS peak FROM coh c""",
    num=["peak"], plain=["stay_id"]))
def window_max(spark: SparkSession, sf: str) -> DataFrame:
    return _at_t0(
        spark, sf, lambda s: lookups.window_value(s.tables["bg"], "hadm_id", "charttime", "lactate", "peak", "max", 6), "peak"
    )


@query("overlap_max", oracle("""SELECT c.stay_id, (SELECT max(d.dose) FROM drug d WHERE d.stay_id = c.stay_id AND d.starttime < c.t0_time
    AND coalesce(d.endtime, c.t0_time) > c.t0_time - INTERVAL 6 HOUR) AS dose FROM coh c""", num=["dose"], plain=["stay_id"]))
def overlap_max(spark: SparkSession, sf: str) -> DataFrame:
    """Maximum over all intervals that meet the window."""
    dose = "norepinephrine_equivalent_dose"
    return _at_t0(
        spark, sf, lambda s: lookups.overlap_value(s.tables[dose], "stay_id", "starttime", "endtime", dose, "dose", 6), "dose"
    )


@query("range_min", oracle("SELECT stay_id, scr_baseline FROM outc", num=["scr_baseline"], plain=["stay_id"]))
def range_min(spark: SparkSession, sf: str) -> DataFrame:
    """Minimum over a range whose two ends come from two tables."""
    s, units = _cohort(spark, sf)
    units = joins.left_join(units, s.tables["admissions"], "hadm_id", ["admittime"])
    low = lookups.window_value(
        s.tables["chemistry"], "hadm_id", "charttime", "creatinine", "scr_baseline", "min", lower="admittime"
    )
    return lookups.gather(units, "stay_id", "t0_time", [low]).select("scr_baseline", "stay_id")


@query("first_event_after", oracle("SELECT c.stay_id, t.crrt_start_time FROM coh c LEFT JOIN treat t ON t.stay_id = c.stay_id",
    ts=["crrt_start_time"], plain=["stay_id"]))
def first_event_after(spark: SparkSession, sf: str) -> DataFrame:
    return _at_t0(spark, sf, lambda s: s.panel_lookups()[0][1], "crrt_start_time")


@query("hour_grid", oracle("SELECT stay_id, hour_index, t_start, t_end FROM grid_24", ts=["t_start", "t_end"], plain=["stay_id", "hour_index"]))
def hour_grid(spark: SparkSession, sf: str) -> DataFrame:
    _, units = _cohort(spark, sf)
    return lookups.hour_grid(units, "t0_time", 24).select("stay_id", "hour_index", "t_start", "t_end")


def _on_grid(spark: SparkSession, sf: str, make, *cols: str, n: int = 24) -> DataFrame:
    s, units = _cohort(spark, sf)
    return lookups.gather_slices(units, "stay_id", "t0_time", n, [make(s)]).select("stay_id", "hour_index", *cols)


@query("grid_last", oracle("SELECT stay_id, hour_index, lactate_last6h, ph_last6h FROM panel_24", num=["lactate_last6h", "ph_last6h"], plain=["stay_id", "hour_index"]))
def grid_last(spark: SparkSession, sf: str) -> DataFrame:
    """Newest whole row of the last 6 h at every slice end."""
    cols = {"lactate_last6h": "lactate", "ph_last6h": "ph"}
    return _on_grid(
        spark, sf, lambda s: lookups.last(s.tables["bg"], "hadm_id", "charttime", cols, 6, tiebreak=("event_id",)), *cols
    )


@query("grid_sum", oracle("""SELECT g.stay_id, g.hour_index, (SELECT sum(u.urineoutput) FROM urine u WHERE u.stay_id = g.stay_id
    AND u.charttime > g.t_end - INTERVAL 6 HOUR AND u.charttime <= g.t_end) AS total FROM grid_36 g""", num=["total"], plain=["stay_id", "hour_index"]))
def grid_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _on_grid(
        spark, sf,
        lambda s: lookups.window_value(s.tables["urine_output"], "stay_id", "charttime", "urineoutput", "total", "sum", 6),
        "total", n=36,
    )


@query("grid_max", oracle("SELECT stay_id, hour_index, ne_eq_last1h FROM panel_24", num=["ne_eq_last1h"], plain=["stay_id", "hour_index"]))
def grid_max(spark: SparkSession, sf: str) -> DataFrame:
    dose = "norepinephrine_equivalent_dose"
    return _on_grid(
        spark, sf,
        lambda s: lookups.overlap_value(s.tables[dose], "stay_id", "starttime", "endtime", dose, "ne_eq_last1h", 1),
        "ne_eq_last1h",
    )


@query("grid_overlap", oracle("""SELECT g.stay_id, g.hour_index, CASE WHEN EXISTS (SELECT 1 FROM drug_on d WHERE d.stay_id = g.stay_id AND d.starttime < g.t_end
    AND coalesce(d.endtime, g.t_end) > g.t_end - INTERVAL 3 HOUR) THEN 1 ELSE 0 END AS on_drug FROM grid_24 g""", plain=["stay_id", "hour_index", "on_drug"]))
def grid_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Interval overlap with the last 3 h of every slice."""
    return _on_grid(spark, sf, lambda s: s.drug_overlap("on_drug", 3), "on_drug")


@query("top_row_per_unit", oracle("""SELECT stay_id, charttime, hr FROM (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY hr DESC, event_id DESC) AS rn
    FROM vital) q WHERE rn = 1""", ts=["charttime"], num=["hr"], plain=["stay_id"]))
def top_row_per_unit(spark: SparkSession, sf: str) -> DataFrame:
    """Top row per unit as an aggregate."""
    vital = proxies.tables(spark, sf)["vitalsign"]
    best = F.max_by(F.struct("charttime", "heart_rate"), F.struct("heart_rate", "event_id"))
    return vital.groupBy("stay_id").agg(best.alias("b")).select(
        "b.charttime", F.col("b.heart_rate").alias("hr"), "stay_id"
    )


@query("window_bounds", oracle("""SELECT c.stay_id, c.t0_time - INTERVAL 6 HOUR AS lo, c.t0_time + INTERVAL 24 HOUR AS hi FROM coh c""", ts=["lo", "hi"], plain=["stay_id"]))
def window_bounds(spark: SparkSession, sf: str) -> DataFrame:
    _, units = _cohort(spark, sf)
    return units.select(plus_hours("t0_time", -6).alias("lo"), plus_hours("t0_time", 24).alias("hi"), "stay_id")
