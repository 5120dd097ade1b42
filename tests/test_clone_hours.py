"""Fits on rows at risk in (start, time]: against brute force, and against the same subjects uncut."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.operators import censor, survival
from trialweave.plans import proxies, queries_effects

KINDS = "stay_id int, strategy string, begin double, time double, event int, w double"


def subjects():
    rng = random.Random(21)
    rows = []
    for i in range(90):
        for arm in "AB":
            t = round(rng.expovariate(0.07 if arm == "A" else 0.04), 1)
            rows.append((i, arm, 0.0, min(max(t, 0.1), 28.0), int(t <= 28 and rng.random() < 0.8), rng.choice([0.5, 1.0, 1.7])))
    return rows


def cut(rows, changing=False):
    """Each subject in pieces; with ``changing`` every piece has another weight."""
    rng = random.Random(3)
    out = []
    for i, arm, _, t, e, w in rows:
        marks = sorted({round(rng.uniform(0, t), 2) for _ in range(rng.randint(0, 4))} - {0.0, t})
        edges = [0.0, *marks, t]
        for a, b in zip(edges, edges[1:]):
            out.append((i, arm, a, b, int(e and b == t), w * rng.choice([0.5, 1.0, 2.0]) if changing else w))
    return out


def test_cut_subjects_give_the_same_curve(spark):
    rows = subjects()
    whole = survival.weighted_km(spark.createDataFrame(rows, KINDS), weight="w")
    pieces = survival.weighted_km(spark.createDataFrame(cut(rows), KINDS), weight="w", start="begin")
    want = {(r["strategy"], r["ticks"]): r for r in whole.collect()}
    got = {(r["strategy"], r["ticks"]): r for r in pieces.collect()}
    assert set(want) <= set(got)
    for k, r in want.items():
        for c in ("surv", "n_risk", "n_event", "std_err"):
            assert math.isclose(r[c], got[k][c], rel_tol=1e-9, abs_tol=1e-9)
        assert (r["count_risk"], r["count_event"]) == (got[k]["count_risk"], got[k]["count_event"])
    a, b = ({r["strategy"]: r for r in survival.rmst(c, 28).collect()} for c in (whole, pieces))
    for arm in "AB":
        assert math.isclose(a[arm]["rmst"], b[arm]["rmst"], rel_tol=1e-9)
        assert math.isclose(a[arm]["rmst_se"], b[arm]["rmst_se"], rel_tol=1e-9)


def test_changing_weights_match_brute_force(spark):
    rows = cut(subjects(), changing=True)
    rows += [(500, "A", 5.0, 5.0, 1, 9.0), (501, "A", 6.0, 4.0, 1, 9.0), (502, "A", None, 4.0, 1, 9.0), (503, "B", 0.0, 4.0, 1, None)]
    km = survival.weighted_km(spark.createDataFrame(rows, KINDS), weight="w", start="begin")
    got = {(r["strategy"], round(r["time"], 6)): (r["surv"], r["n_risk"]) for r in km.collect()}
    kept = [r for r in rows if None not in r and r[2] < r[3]]
    for arm in "AB":
        s = 1.0
        for t in sorted({r[3] for r in kept if r[1] == arm}):
            n = sum(r[5] for r in kept if r[1] == arm and r[2] < t <= r[3])
            s *= 1 - sum(r[5] for r in kept if r[1] == arm and r[3] == t and r[4]) / n
            assert math.isclose(got[arm, round(t, 6)][0], s, abs_tol=1e-9)
            assert math.isclose(got[arm, round(t, 6)][1], n, rel_tol=1e-9)


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_cut_subjects_give_the_same_cox_fit(spark, ties):
    rows = subjects()
    fit = {"weight": "w", "ties": ties, "cluster": "stay_id"}
    a = survival.weighted_cox(spark.createDataFrame(rows, KINDS), **fit).first()
    b = survival.weighted_cox(spark.createDataFrame(cut(rows), KINDS), start="begin", **fit).first()
    for c in ("log_hr", "se", "robust_se", "p"):
        assert math.isclose(a[c], b[c], rel_tol=1e-7), c
    assert b["converged"] and a["n_event"] == b["n_event"]


def test_cox_with_changing_weights_matches_brute_force(spark):
    rows = cut(subjects(), changing=True)
    got = survival.weighted_cox(spark.createDataFrame(rows, KINDS), weight="w", start="begin", ties="breslow").first()
    x = np.array([r[1] == "B" for r in rows], float)
    start, stop, e, w = (np.array([r[i] for r in rows], float) for i in (2, 3, 4, 5))
    b = 0.0
    for _ in range(30):
        u = info = 0.0
        for t in np.unique(stop[e == 1]):
            risk, dead = (start < t) & (stop >= t), (stop == t) & (e == 1)
            theta = (w * np.exp(b * x))[risk]
            mean = (theta * x[risk]).sum() / theta.sum()
            u += (w[dead] * (x[dead] - mean)).sum()
            info += w[dead].sum() * mean * (1 - mean)
        b += u / info
    assert math.isclose(got["log_hr"], b, rel_tol=1e-8) and math.isclose(got["se"], info**-0.5, rel_tol=1e-6)


def test_a_level_without_events_has_no_estimate(spark):
    rows = [(i, "AB"[i % 2], 0.0, 1.0 + i % 5, int(i < 40 and i % 3 == 0), 1.0) for i in range(80)]
    df = spark.createDataFrame(rows, KINDS).withColumn("g", F.when(F.col("stay_id") < 40, "x").otherwise("y"))
    got = {r["level"]: r for r in survival.subgroup_cox(df, ["g"], 10, weight="w", start="begin").collect()}
    assert got["x"]["converged"] and got["x"]["hr"] is not None
    assert not got["y"]["converged"] and got["y"]["hr"] is None and got["y"]["se"] is None and got["y"]["n_event"] == 0


def test_subgroup_rows_that_differ_in_weight_alone_are_merged_before_the_fit(spark, monkeypatch):
    rows = [(i, arm, h / 24, (h + 1) / 24 if h < 23 else t, e if h == 23 else 0, w * (1 + h % 3)) for i, arm, _, t, e, w in subjects() if t > 1 for h in range(24)]
    rows += [rows[0], rows[-1], (700, "A", None, 4.0, 1, 9.0), (701, "B", 0.0, None, 1, 9.0), (702, "B", 0.0, 4.0, 1, None), (703, "A", 0.0, 4.0, 1, -1.0)]
    df = spark.createDataFrame(rows, KINDS).withColumns(
        {"g": F.when(F.col("stay_id") % 3 > 0, "x").otherwise("y"), "k": F.when(F.col("stay_id") % 5 > 0, "u")}
    )
    seen = []
    fit = survival.weighted_cox
    monkeypatch.setattr(survival, "weighted_cox", lambda large, *args, **kw: seen.append(large.count()) or fit(large, *args, **kw))
    got = {(r["subgroup"], r["level"]): r for r in survival.subgroup_cox(df, ["g", "k"], 10, weight="w", start="begin").collect()}
    assert set(got) == {("g", "x"), ("g", "y"), ("k", "u")}
    for (flag, level), r in got.items():
        want = fit(df.filter(F.col(flag) == level), weight="w", start="begin").first()
        assert (r["n"], r["n_event"], r["converged"]) == (want["n"], want["n_event"], True)
        assert math.isclose(r["log_hr"], want["log_hr"], rel_tol=1e-8) and math.isclose(r["se"], want["se"], rel_tol=1e-8)
    assert seen[0] < sum(r["n"] for r in got.values()) / 5


def test_clone_hours(spark):
    hours = [(s, a, h, 1.0 + h, int(not (s == 2 and a == "B" and h >= 3))) for s in (1, 2, 3, 4) for a in "AB" for h in range(24)]
    weighted = spark.createDataFrame(hours, "stay_id int, strategy string, hour_index int, ipcw_trunc double, at_risk_after_k int")
    outcome = spark.sql(
        "SELECT stay_id, timestamp_ntz'2024-01-01 00:00:00' AS t0_time, deathtime FROM VALUES (1, timestamp_ntz'2024-01-01 05:30:00'), "
        "(2, timestamp_ntz'2024-01-11 00:00:00'), (3, CAST(NULL AS timestamp_ntz)), (4, timestamp_ntz'2023-12-31 00:00:00') AS v(stay_id, deathtime)"
    )
    rows = censor.clone_hours(weighted, outcome, counting=True).collect()
    got = {(r["stay_id"], r["strategy"], r["hour_index"]): (r["start"], r["time"], r["event"], r["ipcw_trunc"]) for r in rows}
    assert not any(k[0] == 4 for k in got)  # dead at t0
    assert sorted(h for s, a, h in got if (s, a) == (1, "A")) == [0, 1, 2, 3, 4, 5]
    assert got[1, "A", 5] == (5 / 24, 5.5 / 24, 1, 6.0) and got[1, "A", 4] == (4 / 24, 5 / 24, 0, 5.0)
    assert sorted(h for s, a, h in got if (s, a) == (2, "B")) == [0, 1, 2]  # censored, no event later
    assert got[2, "A", 23] == (23 / 24, 10.0, 1, 24.0) and got[3, "A", 23] == (23 / 24, 28.0, 0, 24.0)
    whole = {(r["stay_id"], r["strategy"], r["hour_index"]): (r["time"], r["event"]) for r in censor.clone_hours(weighted, outcome).collect()}
    assert whole[1, "A", 23] == (5.5 / 24, 1) and whole[2, "B", 2] == (10.0, 1) and len(whole) == 24 * 5 + 3


def test_queries_on_clone_hours_read_the_events_once(spark, tmp_path, monkeypatch):
    spark.sql(
        "SELECT id AS event_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS ts, id % 5 AS user_id, 'error' AS event_type, 1.0D AS value FROM range(50)"
    ).write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("SELECT id AS c_custkey, 1 AS c_nationkey, 'M' AS c_mktsegment FROM range(5)").write.parquet(f"{tmp_path}/customer.parquet")
    plans = []

    def keep(units, kdigo):
        plans.append(kdigo)
        raise LookupError

    monkeypatch.setattr(proxies, "time_zero", keep)
    with pytest.raises(LookupError):
        queries_effects._risk_rows(spark, str(tmp_path))
    assert plans[0].count() == 50
    assert not [f for f in plans[0].inputFiles() if f"{tmp_path}/events" in f]
