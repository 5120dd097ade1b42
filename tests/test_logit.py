"""The distributed logistic fit against a dense Newton fit in numpy."""

import math

import numpy as np
import pytest

from trialweave.operators import logit, pooled
from trialweave.operators.logit import ModelSpec, fit_models, predicted


def rows():
    r = np.random.default_rng(4)
    out = []
    for i in range(1500):
        hour, arm, sex = int(r.integers(0, 5)), "AB"[int(r.integers(0, 2))], ("F", "M", "X")[int(r.integers(0, 3))]
        x, z = float(r.normal(50, 9)), float(r.normal(7.2, 0.1))
        eta = -1.5 + 0.05 * (x - 50) + 3 * (z - 7.2) + 0.6 * (arm == "B") - 0.4 * (sex == "M") + 0.2 * hour
        y = int(r.random() < 1 / (1 + math.exp(-eta)))
        if hour == 3:
            y = 0  # no event in this hour
        if hour == 4 and i % 3 == 0:
            hour, y = 9, 1  # events only
        out.append((i, hour, arm, sex, x, z, 2 * x - 1, y, float(r.uniform(0.2, 4))))
    out[3] = (*out[3][:4], None, *out[3][5:])
    out[4] = (*out[4][:8], -1.0)
    out[5] = (*out[5][:8], None)
    out[6] = (6, None, *out[6][2:])
    return out


KINDS = "id int, hour_index int, strategy string, sex string, x double, z double, twice double, y int, w double"


def dense(data, names, weighted):
    """Newton steps on a dense design of the hours that hold both outcomes."""
    data = [d for d in data if None not in d[:8] and d[1] not in (3, 9) and (not weighted or (d[8] or 0) > 0)]
    hours = sorted({d[1] for d in data})
    x = np.array([[*(float(d[1] == h) for h in hours), *(f(d) for f in names.values())] for d in data])
    y = np.array([d[7] for d in data], float)
    w = np.array([d[8] if weighted else 1.0 for d in data])
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]), x.T @ (w * (y - p)))
    return dict(zip([*hours, *names], b))


NAMES = {
    "strategy=B": lambda d: float(d[2] == "B"), "sex=M": lambda d: float(d[3] == "M"), "sex=X": lambda d: float(d[3] == "X"),
    "x": lambda d: d[4], "z": lambda d: d[5],
}


@pytest.mark.parametrize("weighted", [False, True])
def test_two_models_equal_a_dense_fit(spark, weighted):
    data = rows()
    df = spark.createDataFrame(data, KINDS).repartition(3).cache()
    weight = "w" if weighted else None
    specs = [ModelSpec(("strategy", "sex", "x", "twice", "z"), label="y", weight=weight), ModelSpec(("strategy",), label="y", weight=weight)]
    full, small = fit_models(df, specs)
    want = dense(data, NAMES, weighted)
    assert full.converged and full.score < 1e-6 and full.aliased == ("twice",)
    for name in NAMES:
        assert math.isclose(full.coefficients[name], want[name], rel_tol=1e-6, abs_tol=1e-8)
    for hour in (0, 1, 2, 4):
        assert math.isclose(full.intercepts[hour], want[hour], rel_tol=1e-6)
    assert full.intercepts[3] == -math.inf and full.intercepts[9] == math.inf
    assert small.converged and set(small.coefficients) == {"strategy=B"}
    got = {r["id"]: r["p"] for r in df.select("id", predicted(full).alias("p")).collect()}
    assert got[3] is None and got[6] is None and got[4] is not None
    for d in data:
        if d[1] in (3, 9) and None not in d[:8]:
            assert got[d[0]] == float(d[1] == 9)
        elif None not in d[:8]:
            eta = want[d[1]] + sum(want[n] * f(d) for n, f in NAMES.items())
            assert math.isclose(got[d[0]], 1 / (1 + math.exp(-eta)), rel_tol=1e-6)


def test_separation_warns_and_ridge_converges(spark):
    df = spark.createDataFrame([(i, i % 3, float(i % 2), int(i % 2 == 1)) for i in range(60)], "id int, hour_index int, x double, y int")
    with pytest.warns(UserWarning):
        (model,) = fit_models(df, [ModelSpec(("x",), label="y")], max_iter=12)
    assert not model.converged
    (model,) = fit_models(df, [ModelSpec(("x",), label="y", ridge=1.0)])
    assert model.converged and 0 < model.coefficients["x"] < 50


def test_no_rows_unseen_levels_and_many_levels(spark):
    kinds = "hour_index int, s string, y int"
    (model,) = fit_models(spark.createDataFrame([], kinds), [ModelSpec(("s",), label="y")])
    assert model.converged and model.n == 0
    some = spark.createDataFrame([(i % 2, "ab"[i % 3 > 0], int(i % 5 == 0)) for i in range(90)], kinds)
    assert some.select(predicted(model).alias("p")).where("p is not null").count() == 0
    (model,) = fit_models(some, [ModelSpec(("s",), label="y")])
    other = spark.createDataFrame([(0, "c", 0), (7, "a", 0), (0, None, 0), (0, "a", 0)], kinds)
    assert [r[0] is None for r in other.select(predicted(model)).collect()] == [True, True, True, False]
    many = spark.range(200).selectExpr("0 AS hour_index", "cast(id AS string) AS s", "cast(id % 2 AS int) AS y")
    with pytest.raises(ValueError):
        fit_models(many, [ModelSpec(("s",), label="y")])
    with pytest.raises(ValueError):
        fit_models(some, [ModelSpec(("s",), label="y"), ModelSpec((), factor="s", label="y")])


def test_standardised_outcome_hazards(spark):
    """With covariates, hazards are means over all person-days with the arm set to each arm."""
    r = np.random.default_rng(8)
    data = [(("A", "B")[i % 2], (i // 2) % 4, float(r.normal()), float(r.uniform(0.5, 2)), int(r.random() < 0.2 + 0.1 * (i % 2))) for i in range(800)]
    days = spark.createDataFrame(data, "strategy string, day int, x double, w double, died int").cache()
    got = {(a["strategy"], a["day"]): a["hazard"] for a in pooled.logistic_hazard(days, terms=("x",)).collect()}
    (model,) = fit_models(days, [ModelSpec(("strategy", "x"), "day", "died", "w")])
    for arm in "AB":
        for day in range(4):
            own = [d for d in data if d[1] == day]
            p = [1 / (1 + math.exp(-(model.intercepts[day] + model.coefficients["strategy=B"] * (arm == "B") + model.coefficients["x"] * d[2]))) for d in own]
            want = sum(d[3] * q for d, q in zip(own, p)) / sum(d[3] for d in own)
            assert math.isclose(got[arm, day], want, rel_tol=1e-9)
    full = {(a["strategy"], a["day"]): a["hazard"] for a in pooled.logistic_hazard(days, interaction=True).collect()}
    assert full == {(a["strategy"], a["day"]): a["hazard"] for a in pooled.saturated_hazard(days).collect()}


def test_ridge_equals_a_dense_fit(spark):
    data = rows()
    df = spark.createDataFrame(data, KINDS).cache()
    used = [d for d in data if None not in d[:8]]
    sd = {"x": np.std([d[4] for d in used]), "z": np.std([d[5] for d in used])}
    (model,) = fit_models(df, [ModelSpec(("x", "z"), label="y", ridge=5.0)])
    used = [d for d in used if d[1] not in (3, 9)]
    hours = sorted({d[1] for d in used})
    x = np.array([[*(float(d[1] == h) for h in hours), d[4], d[5]] for d in used])
    y = np.array([d[7] for d in used], float)
    penalty = np.diag([0.0] * len(hours) + [5.0 * sd["x"] ** 2, 5.0 * sd["z"] ** 2])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ b)
    assert math.isclose(model.coefficients["x"], b[-2], rel_tol=1e-6)
    assert math.isclose(model.coefficients["z"], b[-1], rel_tol=1e-6)


def test_a_task_sums_cross_products_of_whole_rows(spark):
    rows = [(h, None if i == 3 else float(i % 5), float(i * i % 7), i % 3 % 2) for h in (0, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "hour_index int, a double, b double, censor_k_total int")
    state = logit._start(df, [ModelSpec(("a", "b"))])[0]
    inputs = df.select(*logit._inputs(state, 0))
    assert "Generate" not in inputs._jdf.queryExecution().toString()
    model = (0, state.use, state.alpha, state.beta[state.use], state.mean[state.use], state.sd[state.use])
    schema = "m int, place int, j int, r double, fit double, h0 double, h1 double, h2 double"
    got = {(r["place"], r["j"]): r for r in inputs.coalesce(1).mapInArrow(logit._cross_products([model], 3), schema).collect()}
    for place, level in enumerate(state.open_):
        own = np.array([[1.0, (a - state.mean[0]) / state.sd[0], (b - state.mean[1]) / state.sd[1], y] for h, a, b, y in rows if h == level and a is not None])
        p = 1 / (1 + np.exp(-state.alpha[place]))
        x, y = own[:, :3], own[:, 3]
        for j in range(3):
            assert np.allclose([got[place, j][f"h{k}"] for k in range(3)], (x.T * p * (1 - p)) @ x[:, j])
            assert np.isclose(got[place, j]["r"], x[:, j] @ (y - p))
        assert np.isclose(got[place, 0]["fit"], (y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
