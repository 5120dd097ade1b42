"""Cohort rules, censoring boundaries, outcomes and follow-up times."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trialweave.functions.exprs import band, clamp, driven_by
from trialweave.operators import censor, cohort, lookups

T0 = datetime(2024, 1, 1, 12)
H = timedelta(hours=1)
D = timedelta(days=1)
G = T0 + 24 * H


def panel(spark, rows, n=24):
    """rows: (id, treatment, death, out)"""
    df = spark.createDataFrame(
        [(i, T0, c, d, o) for i, c, d, o in rows],
        "stay_id long, t0_time timestamp_ntz, crrt_start_time timestamp_ntz, death_time timestamp_ntz, icu_outtime timestamp_ntz",
    )
    return lookups.hour_grid(df, "t0_time", n)


def by_clone(df):
    out = {}
    for r in df.orderBy("hour_index").collect():
        out.setdefault((r["stay_id"], r["strategy"]), []).append(r)
    return out


def flagged(rows):
    return [r["hour_index"] for r in rows if r["censor_k_total"] == 1]


def test_protocol_censoring(spark):
    got = by_clone(
        censor.clone_censor(
            panel(spark, [(1, None, None, None), (2, T0 + 5.5 * H, None, None), (3, G, None, None), (4, T0, None, None)])
        )
    )
    assert flagged(got[1, "A"]) == [23] and flagged(got[1, "B"]) == []
    assert flagged(got[2, "A"]) == [] and flagged(got[2, "B"]) == [5]
    # Treatment exactly at the end of the grace period counts as not started.
    assert flagged(got[3, "A"]) == [23] and got[3, "B"][0]["task_maintained_no_early_24h"] == 1
    # Treatment at t0: arm B is never flagged and never at risk.
    assert flagged(got[4, "B"]) == [] and all(r["at_risk_after_k"] == 0 for r in got[4, "B"])
    assert got[4, "A"][0]["task_completed_within_24h"] == 1


def test_administrative_censoring(spark):
    death, out = T0 + 6 * H, T0 + 3 * H
    got = by_clone(
        censor.clone_censor(
            panel(
                spark,
                [(1, None, death, out), (2, T0 + 6 * H, None, T0 + 6 * H), (3, None, T0, None), (4, None, G, T0 + 30 * H)],
            )
        )
    )
    # Death takes precedence even when the unit was left earlier.
    assert got[1, "A"][0]["admin_censor_time"] == death
    # Slice end belongs to the slice that ends there.
    assert flagged(got[1, "A"]) == [5] and got[1, "A"][5]["at_risk_after_k"] == 0
    # Tie: administrative censoring drives.
    assert (got[2, "B"][0]["admin_censor_driving"], got[2, "B"][0]["proto_censor_driving"]) == (1, 0)
    assert got[3, "A"][0]["admin_censor_time"] is None
    assert got[4, "A"][0]["admin_censor_time"] is None


def test_clone_invariants(spark):
    rows = [(i, T0 + i * 0.7 * H if i % 2 else None, T0 + i * 1.3 * H if i % 3 else None, T0 + i * H) for i in range(40)]
    got = by_clone(censor.clone_censor(panel(spark, rows)))
    assert len(got) == 80
    for clone in got.values():
        assert len(flagged(clone)) <= 1
        assert all(r["censor_k_total"] + r["at_risk_after_k"] <= 1 for r in clone)


def test_risk_after_slice_never_sees_the_event(spark):
    clones = censor.clone_censor(panel(spark, [(1, None, None, None), (2, T0 + 5 * H, None, None)]))
    after = clones.filter(censor.at_risk("after"))
    start = clones.filter(censor.at_risk("start"))
    assert after.agg(F.sum("censor_k_total")).first()[0] == 0
    assert start.agg(F.sum("censor_k_total")).first()[0] == 2


def test_grace_is_a_parameter(spark):
    got = by_clone(censor.clone_censor(panel(spark, [(1, T0 + 15 * H, None, None)], 12), grace_h=12))
    assert flagged(got[1, "A"]) == [11] and flagged(got[1, "B"]) == []


def deaths(spark, *times):
    return spark.createDataFrame([(i, T0, t) for i, t in enumerate(times)], "stay_id long, t0_time timestamp_ntz, deathtime timestamp_ntz")


def test_time_to_event(spark):
    df = deaths(spark, None, T0, T0 + 7 * D, T0 + 28 * D, T0 + 40 * D)
    got = {r["stay_id"]: (r["time"], r["event"]) for r in censor.time_to_event(df).collect()}
    assert got == {0: (28.0, 0), 2: (7.0, 1), 3: (28.0, 1), 4: (28.0, 0)}
    coded = {r["stay_id"]: (r["time"], r["event"]) for r in censor.time_to_event(df, as_coded=True).collect()}
    assert coded == {0: (None, 0), 1: (0.0, 0), 2: (7.0, 1), 3: (28.0, 1), 4: (28.0, 0)}


def test_follow_up_can_stop_at_censoring(spark):
    df = deaths(spark, T0 + 7 * D, T0 + 7 * D, None).withColumn(
        "stop", F.when(F.col("stay_id") != 1, F.lit(T0 + 2 * D).cast("timestamp_ntz"))
    )
    got = {r["stay_id"]: (r["time"], r["event"]) for r in censor.time_to_event(df, stop_at="stop").collect()}
    assert got == {0: (2.0, 0), 1: (7.0, 1), 2: (2.0, 0)}


def test_outcome_boundaries(spark):
    times = [T0, T0 + 7 * D, T0 + 28 * D, T0 + 29 * D, None]
    units = spark.createDataFrame([(i, i, i, T0) for i in range(6)], "subject_id long, hadm_id long, stay_id long, t0_time timestamp_ntz")
    adm = spark.createDataFrame([(i, T0 - 5 * D, t) for i, t in enumerate(times)], "hadm_id long, admittime timestamp_ntz, deathtime timestamp_ntz")
    labs = spark.createDataFrame(
        [(4, T0 - 5 * D, 2.0), (4, T0, 1.0), (4, T0 + 28 * D, 1.5), (4, T0 + 29 * D, 9.0), (3, T0 + D, 1.0)],
        "hadm_id long, charttime timestamp_ntz, creatinine double",
    )
    low = lookups.window_value(labs, "hadm_id", "charttime", "creatinine", "scr_baseline", "min", lower="admittime")
    last = lookups.last_ahead(labs, "hadm_id", "charttime", {"scr_28d": "creatinine"}, 24 * 28, "creatinine")
    got = {r["stay_id"]: r for r in censor.outcomes(units, adm, low, last).collect()}
    assert [got[i]["death_28d"] for i in range(6)] == [0, 1, 1, 0, 0, None]
    assert [got[i]["alive_28d"] for i in range(6)] == [0, 0, 0, 1, 1, None]
    assert [got[i]["death_7d"] for i in range(5)] == [0, 1, 0, 0, 0]
    assert (got[4]["scr_baseline"], got[4]["scr_28d"], got[4]["renal_recovery_28d_scr"]) == (1.0, 1.5, 1)
    assert got[3]["renal_recovery_28d_scr"] == 0


def test_first_unit_is_chosen_before_the_rules(spark):
    u = spark.createDataFrame(
        [(10, 1, 10, T0, T0 + 3 * D, 17.0), (11, 1, 11, T0 + 9 * D, T0 + 12 * D, 40.0), (20, 2, 20, T0, T0 + 3 * D, 18.0),
         (30, 3, 30, None, T0, 50.0), (31, 3, 31, T0, T0 + 3 * D, 50.0)],
        "stay_id long, subject_id long, hadm_id long, intime timestamp_ntz, outtime timestamp_ntz, age double",
    ).withColumns({"gender": F.lit("F"), "race": F.lit("x"), "los_icu": F.lit(3.0)})
    adm = u.select("hadm_id", F.lit("i").alias("insurance"))
    inf = spark.createDataFrame(
        [(10, True, T0), (11, True, T0 + 10 * D), (20, True, T0 + 3 * D), (31, True, T0)],
        "stay_id long, sepsis3 boolean, suspected_infection_time timestamp_ntz",
    )
    wt = u.select("stay_id", F.lit(70.0).alias("weight"))
    codes = spark.createDataFrame([(20, 9, "N186"), (31, 10, "N186")], "hadm_id long, icd_version int, icd_code string")
    rules = cohort.Eligibility(excluded_codes={10: ("N186",), 9: ("5856",)})
    assert [r["stay_id"] for r in cohort.eligible(u, adm, inf, wt, codes, rules).collect()] == [20]


def test_time_zero_is_capped_at_entry(spark):
    core = spark.createDataFrame([(1, T0), (2, T0), (3, T0)], "stay_id long, intime timestamp_ntz")
    stages = spark.createDataFrame(
        [(1, T0 + 2 * H, 3), (1, T0 + H, 2), (2, T0 + 9 * H, 3), (2, T0 + 20 * H, 3)], "stay_id long, charttime timestamp_ntz, aki_stage int"
    )
    got = {r["stay_id"]: r["t0_time"] for r in cohort.time_zero(core, stages).collect()}
    assert got == {1: T0, 2: T0 + 3 * H}


def test_prior_treatment_at_t0_does_not_exclude(spark):
    t0 = spark.createDataFrame([(1, T0), (2, T0), (3, T0)], "stay_id long, t0_time timestamp_ntz")
    inf = spark.createDataFrame([(i, True, T0) for i in (1, 2)] + [(3, None, T0)], "stay_id long, sepsis3 boolean, suspected_infection_time timestamp_ntz")
    drug = spark.createDataFrame([(i, T0 - H, None) for i in (1, 2, 3)], "stay_id long, starttime timestamp_ntz, endtime timestamp_ntz")
    dev = spark.createDataFrame([(1, T0), (2, T0 - H)], "stay_id long, charttime timestamp_ntz")
    screened = cohort.screen(
        t0, inf, lookups.overlaps(drug, "stay_id", "starttime", "endtime", "drug_overlap", 6), {"device": (dev, F.lit(True))}
    )
    assert [r["stay_id"] for r in cohort.index_cohort(screened).collect()] == [1]
    flow = {r["step_order"]: r["n_value"] for r in cohort.attrition(t0, screened).collect()}
    assert flow == {1: 3, 2: 3, 3: 0, 4: 1, 5: 2, 6: 1, 7: 0, 8: 1}


def test_bands_clamp_and_pathway(spark):
    df = spark.createDataFrame([(0.29,), (0.3,), (0.5,), (None,)], "x double")
    labels = [r[0] for r in df.select(band("x", (0.3, 0.5), ("a", "b", "c"))).collect()]
    assert labels == ["a", "b", "c", "missing"]
    assert [r[0] for r in df.select(clamp("x", 0.3, 0.4)).collect()] == [0.3, 0.3, 0.4, None]
    st = spark.createDataFrame([(3, 3), (3, 1), (2, 3), (2, 2), (3, None), (None, None)], "u int, c int")
    names = ("uo", "scr", "mixed", "unknown")
    assert [r[0] for r in st.select(driven_by("u", "c", names)).collect()] == ["mixed", "uo", "scr", "unknown", "uo", "unknown"]
