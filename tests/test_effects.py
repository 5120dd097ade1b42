"""Running sums, quantiles, weights, survival and Cox against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.functions.running import exact_quantiles, running_counts, running_sums
from trialweave.operators import diagnostics, pooled, survival, weights


@pytest.fixture(scope="module")
def subjects(spark):
    rng = random.Random(11)
    rows = []
    for i in range(120):
        for arm in ("A", "B"):
            t = round(rng.expovariate(0.06 if arm == "A" else 0.04), 1)
            rows.append((i, arm, min(t, 28.0), int(t <= 28 and rng.random() < 0.8), rng.choice([0.5, 1.0, 1.7, 2.2])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "stay_id int, strategy string, time double, event int, w double")


@pytest.mark.parametrize("shape", [(1 << 14, 1), (4, 0), (3, 1), (2, 4)])
@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_over_buckets(spark, descending, shape):
    rng = random.Random(1)
    rows = [(g, t, rng.random()) for g in "ab" for t in sorted(rng.sample(range(-5000, 5000), 300))]
    df = spark.createDataFrame(rows, "g string, t long, v double")
    got = {(r["g"], r["t"]): r["s"] for r in running_sums(df, ["g"], "t", {"s": "v"}, descending, 97, *shape).collect()}
    assert len(got) == len(rows)
    for g in "ab":
        total = 0.0
        for _, t, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=descending):
            total += v
            assert math.isclose(got[g, t], total, rel_tol=1e-12)


def test_running_counts(spark):
    df = spark.createDataFrame([("x", float(i * i), i + 1) for i in range(50)], "type string, v double, n long")
    got = {r["v"]: r["c"] for r in running_counts(df, ["type"], "v", "n", "c", buckets=7).collect()}
    assert got == {float(i * i): sum(range(1, i + 2)) for i in range(50)}


@pytest.mark.parametrize("small", [10, 500, 10**6])
def test_exact_quantiles(spark, small):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.lognormal(size=3000), np.full(2000, 1.25), rng.lognormal(size=1000)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 50, "v double").repartition(5)
    probs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = exact_quantiles(df, ["v"], probs, small=small, accuracy=200)
    for p in probs:
        assert math.isclose(got["v", p], float(np.quantile(values, p)), rel_tol=1e-9)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(df, ["v"], [0.5]) == {("v", 0.5): None}


def brute_km(rows):
    out, s = {}, 1.0
    for t in sorted({r[2] for r in rows}):
        n = sum(r[4] for r in rows if r[2] >= t)
        d = sum(r[4] for r in rows if r[2] == t and r[3])
        s *= 1 - d / n
        out[t] = s
    return out


def test_km_matches_brute_force(spark, subjects):
    km = survival.weighted_km(frame(spark, subjects), weight="w")
    got = {(r["strategy"], round(r["time"], 6)): r["surv"] for r in km.collect()}
    for arm in "AB":
        want = brute_km([r for r in subjects if r[1] == arm])
        for t, s in want.items():
            assert math.isclose(got[arm, round(t, 6)], s, abs_tol=1e-9)


def test_unit_weights_equal_no_weights(spark, subjects):
    df = frame(spark, subjects).withColumn("one", F.lit(1.0))
    a = {(r["strategy"], r["ticks"]): r["surv"] for r in survival.weighted_km(df).collect()}
    b = {(r["strategy"], r["ticks"]): r["surv"] for r in survival.weighted_km(df, weight="one").collect()}
    assert a == b


def test_curve_is_monotone_and_areas_add_up(spark, subjects):
    km = survival.weighted_km(frame(spark, subjects), weight="w")
    rows = km.orderBy("strategy", "time").collect()
    for x, y in zip(rows, rows[1:]):
        if x["strategy"] == y["strategy"]:
            assert y["surv"] <= x["surv"] + 1e-12
    for r in survival.rmst(km, 28).collect():
        assert math.isclose(r["rmst"] + r["rmtl"], 28.0)
        curve = brute_km([q for q in subjects if q[1] == r["strategy"]])
        times = [0.0, *[t for t in curve if t < 28], 28.0]
        values = [1.0, *[curve[t] for t in curve if t < 28]]
        area = sum(s * (b - a) for s, a, b in zip(values, times, times[1:]))
        assert math.isclose(r["rmst"], area, rel_tol=1e-9)


def test_curve_on_a_grid(spark):
    rows = [(1, "A", 2.0, 1, 1.0), (2, "A", 4.0, 0, 1.0), (3, "B", 3.0, 1, 1.0), (4, "B", 3.0, 1, 1.0)]
    km = survival.weighted_km(frame(spark, rows))
    got = {(r["strategy"], r["time"]): r["surv"] for r in survival.km_at(km, [0, 2, 3, 5]).collect()}
    assert got == {("A", 0.0): 1.0, ("A", 2.0): 0.5, ("A", 3.0): 0.5, ("B", 0.0): 1.0, ("B", 2.0): 1.0, ("B", 3.0): 0.0}
    table = {(r["strategy"], r["time"]): r["count_risk"] for r in survival.risk_table(km, [0, 2, 2.5, 4.5]).collect()}
    assert table == {
        ("A", 0.0): 2, ("A", 2.0): 2, ("A", 2.5): 1, ("A", 4.5): 0,
        ("B", 0.0): 2, ("B", 2.0): 2, ("B", 2.5): 2, ("B", 4.5): 0,
    }


def brute_cox(rows, ties):
    """Newton on the weighted partial likelihood, then a dfbeta sandwich by perturbing weights."""
    t = np.array([r[2] for r in rows])
    x = np.array([1.0 if r[1] == "B" else 0.0 for r in rows])
    e = np.array([r[3] for r in rows])
    w0 = np.array([r[4] for r in rows])

    def score(b, w):
        u = i = 0.0
        for time in np.unique(t[e == 1]):
            risk, dead = t >= time, (t == time) & (e == 1)
            k, m = int(dead.sum()), w[dead].mean()
            u += (w[dead] * x[dead]).sum()
            for j in range(k):
                f = j / k if ties == "efron" else 0.0
                th = w * np.exp(b * x)
                s0 = th[risk].sum() - f * th[dead].sum()
                s1 = (th * x)[risk].sum() - f * (th * x)[dead].sum()
                u -= m * s1 / s0
                i += m * (s1 / s0) * (1 - s1 / s0)
        return u, i

    b = 0.0
    for _ in range(25):
        u, i = score(b, w0)
        b += u / i
    return b, 1 / math.sqrt(score(b, w0)[1]), lambda w: score(b, w)[0]


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_cox_matches_brute_force(spark, subjects, ties):
    row = survival.weighted_cox(frame(spark, subjects), weight="w", ties=ties).first()
    b, se, _ = brute_cox(subjects, ties)
    assert row["converged"]
    assert math.isclose(row["log_hr"], b, abs_tol=1e-8)
    assert math.isclose(row["se"], se, rel_tol=1e-6)


def test_robust_variance_matches_weight_derivatives(spark, subjects):
    """Breslow score residuals are the derivatives of the score by each case weight."""
    rows = subjects[:80]
    row = survival.weighted_cox(frame(spark, rows), weight="w", ties="breslow", cluster="stay_id").first()
    b, se, score = brute_cox(rows, "breslow")
    w = np.array([r[4] for r in rows])
    clusters = {}
    for j, r in enumerate(rows):
        up, down = w.copy(), w.copy()
        up[j] += 1e-5
        down[j] -= 1e-5
        clusters[r[0]] = clusters.get(r[0], 0.0) + w[j] * (score(up) - score(down)) / 2e-5
    want = math.sqrt(sum(u * u for u in clusters.values())) * se * se
    assert math.isclose(row["robust_se"], want, rel_tol=1e-4)


def test_grouped_cox_equals_separate_fits_and_small_groups_are_skipped(spark, subjects):
    df = frame(spark, subjects).withColumn("g", F.when(F.col("stay_id") < 60, "x").when(F.col("stay_id") < 85, "y").otherwise("z"))
    df = df.filter(~((F.col("stay_id") == 84) & (F.col("strategy") == "A")))
    got = {r["level"]: r for r in survival.subgroup_cox(df, ["g"], 50, weight="w").collect()}
    assert set(got) == {"x", "z"}  # y has 49 rows
    only = survival.weighted_cox(df.filter(F.col("g") == "x"), weight="w").first()
    assert math.isclose(got["x"]["log_hr"], only["log_hr"], rel_tol=1e-9)
    fits = survival.subgroup_cox(df, ["g"], 10, weight="w")
    test = survival.interaction_test(fits).first()
    rows = fits.collect()
    v = [1 / r["se"] ** 2 for r in rows]
    mean = sum(a * r["log_hr"] for a, r in zip(v, rows)) / sum(v)
    q = sum(a * (r["log_hr"] - mean) ** 2 for a, r in zip(v, rows))
    assert math.isclose(test["q"], q, rel_tol=1e-9)
    assert math.isclose(test["p_interaction"], math.exp(-q / 2), rel_tol=1e-6)


def test_many_ties_are_cut_into_chunks(spark, monkeypatch):
    rows = [(i, "AB"[i % 2], 1.0 + (i % 3), 1, 1.0 + (i % 4) / 4) for i in range(60)]
    whole = survival.weighted_cox(frame(spark, rows), weight="w").first()["log_hr"]
    monkeypatch.setattr(survival, "_TIE_CHUNK", 7)
    assert math.isclose(survival.weighted_cox(frame(spark, rows), weight="w").first()["log_hr"], whole, rel_tol=1e-9)
    assert math.isclose(whole, brute_cox(rows, "efron")[0], abs_tol=1e-8)


def test_p_values(spark):
    df = spark.createDataFrame([(1.0, 1), (3.841459, 1), (5.991465, 2), (7.814728, 3), (9.487729, 4)], "q double, df int")
    got = [r[0] for r in df.select(survival.chi_square_p(F.col("q"), F.col("df"))).collect()]
    assert math.isclose(got[0], 0.317310508, abs_tol=1e-6)
    assert all(math.isclose(p, 0.05, abs_tol=1e-6) for p in got[1:])


def hazards(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        for arm in "AB":
            for h in range(4):
                c = int(rng.random() < 0.05 + 0.03 * h + (0.05 if arm == "B" else 0))
                rows.append((i, arm, h, c, rng.random(), None if i == 0 else rng.random()))
                if c:
                    break
    return spark.createDataFrame(rows, "stay_id int, strategy string, hour_index int, censor_k_total int, x double, y double").cache()


def test_equal_models_give_unit_weights_and_modes_are_reciprocal(spark):
    df = weights.cell_hazard(hazards(spark), ["strategy", "hour_index"], "p")
    same = weights.stabilized_weights(df, "p", "p").agg(F.min("ipcw"), F.max("ipcw")).first()
    assert (round(same[0], 12), round(same[1], 12)) == (1.0, 1.0)
    both = weights.cell_hazard(df, ["hour_index"], "q")
    doc = weights.stabilized_weights(both, "q", "p")
    coded = weights.stabilized_weights(both, "q", "p", "as_coded").withColumnRenamed("ipcw", "coded")
    keys = ["stay_id", "strategy", "hour_index"]
    joined = doc.select(*keys, "ipcw").join(coded.select(*keys, "coded"), keys)
    assert joined.filter(F.abs(F.col("ipcw") * F.col("coded") - 1) > 1e-9).count() == 0


def test_model_keeps_incomplete_rows_with_null(spark):
    df = hazards(spark)
    model = weights.censor_model(df, ("strategy", "x", "y"))
    scored = weights.predict_hazard(df, model, "p")
    assert scored.count() == df.count()
    assert scored.filter(F.col("p").isNull()).select("stay_id").distinct().collect() == [(0,)]
    # Score equations: expected equals observed in every hour.
    sums = scored.filter("p is not null").groupBy("hour_index").agg(F.sum("p"), F.sum("censor_k_total")).collect()
    assert all(math.isclose(r[1], r[2], abs_tol=1e-3) for r in sums)
    out = weights.stabilized_weights(weights.predict_hazard(scored, weights.censor_model(df, ("strategy",)), "q"), "q", "p")
    assert out.filter("stay_id = 0 and ipcw is not null").count() == 0
    bounds = weights.truncate_weights(out)
    assert bounds.filter("ipcw is null and ipcw_trunc is not null").count() == 0


def test_unknown_slice_makes_later_weights_unknown(spark):
    rows = [(1, "A", 0, 0.1, 0.1), (1, "A", 1, None, 0.1), (1, "A", 2, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "stay_id int, strategy string, hour_index int, num double, den double")
    got = [r["ipcw"] for r in weights.stabilized_weights(df, "num", "den").orderBy("hour_index").collect()]
    assert got == [1.0, None, None]


def test_histogram_and_density(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 1, 9, 10]], "v double")
    got = {r["bin"]: r["n"] for r in diagnostics.histogram(df, "v", 10).collect()}
    assert got == {1: 1, 2: 2, 10: 2, **{b: 0 for b in range(3, 10)}}
    rng = np.random.default_rng(1)
    w = spark.createDataFrame([("raw", float(v)) for v in rng.lognormal(size=500)], "type string, weight double")
    area = diagnostics.density(w, points=256).orderBy("i").collect()
    step = area[1]["log10_weight"] - area[0]["log10_weight"]
    assert 0.9 < sum(r["density"] for r in area) * step < 1.01


def test_pooled_outcome_model(spark, subjects):
    days = pooled.person_periods(frame(spark, subjects), 28, weight="w").cache()
    flat = {(r["strategy"], r["day"]): r["hazard"] for r in pooled.saturated_hazard(days).collect()}
    for (arm, day), h in flat.items():
        rows = [r for r in subjects if r[1] == arm and r[2] > day]
        want = sum(r[4] for r in rows if r[3] and r[2] <= day + 1) / sum(r[4] for r in rows)
        assert math.isclose(h, want, abs_tol=1e-12)
    model = pooled.logistic_hazard(days)
    both = model.join(days.groupBy("strategy", "day").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("died")).alias("d")), ["strategy", "day"])
    sums = both.groupBy("strategy").agg(F.sum(F.col("n") * F.col("hazard")), F.sum("d")).collect()
    assert all(math.isclose(r[1], r[2], rel_tol=1e-3) for r in sums)
