"""Pooled logistic regression fitted by Newton steps over distributed sums.

One step of all models of a fit is one job: per level of the factor, the weighted
cross-products of the terms, the score and the log likelihood.  Only these sums, whose number
depends on the model and not on the data, reach the driver, where the factor's intercepts are
eliminated and the remaining small system is solved.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Levels of a text term and of the factor at most; more are refused as a mistaken column.
MOST_LEVELS, MOST_FACTOR_LEVELS = 64, 1000
#: A term whose variance given the terms before it is a smaller share than this is aliased.
ALIASED = 1e-9
#: Scores, in standard deviations, that count as none when they no longer fall.
STALLED = 1e-6


@dataclass(frozen=True)
class ModelSpec:
    """A model to fit: numeric or text ``terms`` beside the intercepts of ``factor``.

    ``ridge`` penalises the squares of the standardised coefficients, not the intercepts.
    """

    terms: tuple[str, ...]
    factor: str | None = "hour_index"
    label: str = "censor_k_total"
    weight: str | None = None
    ridge: float = 0.0


@dataclass(frozen=True)
class LogitModel:
    """A fitted model.

    ``intercepts`` maps factor levels to log odds; it is infinite where a level holds no
    event or only events, which is the limit of the likelihood there.  ``coefficients`` are
    by term, text terms as ``term=level`` against their first level; aliased terms, which
    the terms before them determine, are listed and have no coefficient.  ``score`` is the
    largest score left over, in units of its standard deviation.
    """

    spec: ModelSpec
    intercepts: Mapping[object, float]
    coefficients: Mapping[str, float]
    levels: Mapping[str, tuple]
    aliased: tuple[str, ...]
    n: float
    log_likelihood: float
    score: float
    steps: int
    converged: bool


@dataclass
class _State:
    """One model while it is fitted; vectors are in standardised terms."""

    spec: ModelSpec
    names: list[str]
    columns: list[Column]
    levels: dict[str, tuple]
    mean: np.ndarray
    sd: np.ndarray
    open_: dict[object, float]
    closed: dict[object, float]
    n: float
    use: list[int] = field(default_factory=list)
    beta: np.ndarray | None = None
    alpha: np.ndarray | None = None
    best: tuple | None = None
    step: tuple | None = None
    score: float = math.inf
    before: float = math.inf
    steps: int = 0
    done: bool = False
    converged: bool = False


def _dummies(df: DataFrame, terms: Sequence[str]) -> tuple[list[str], list[Column], dict[str, tuple]]:
    names, columns, levels = [], [], {}
    for c in terms:
        if isinstance(df.schema[c].dataType, StringType):
            seen = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(MOST_LEVELS + 1).collect()]
            if len(seen) > MOST_LEVELS:
                raise ValueError(f"{c} has more than {MOST_LEVELS} levels")
            levels[c] = tuple(sorted(seen))
            for level in levels[c][1:]:
                names.append(f"{c}={level}")
                columns.append((F.col(c) == level).cast("double"))
        else:
            names.append(c)
            columns.append(F.col(c).cast("double"))
    return names, columns, levels


def _weight(spec: ModelSpec) -> Column:
    """A row's weight, 0 where a term, the factor, the label or the weight is missing."""
    known = F.lit(True)
    for c in (*spec.terms, spec.label, *([spec.factor] if spec.factor else [])):
        known = known & F.col(c).isNotNull()
    own = F.col(spec.weight).cast("double") if spec.weight else F.lit(1.0)
    return F.when(known, F.coalesce(F.greatest(own, F.lit(0.0)), F.lit(0.0))).otherwise(0.0)


def _by_level(rows: DataFrame, factor: str | None, sums: Mapping[str, Column]) -> dict[object, dict]:
    level = F.col(factor) if factor else F.lit("all")
    got = rows.groupBy(level.alias("__level")).agg(*[v.alias(k) for k, v in sums.items()]).limit(MOST_FACTOR_LEVELS + 2).collect()
    if len(got) > MOST_FACTOR_LEVELS + 1:
        raise ValueError(f"{factor} has more than {MOST_FACTOR_LEVELS} levels")
    return {r["__level"]: r.asDict() for r in got if r["__level"] is not None}


def _start(df: DataFrame, specs: Sequence[ModelSpec]) -> list[_State]:
    """Standardisation, factor levels and starting values of every model, from one aggregate."""
    coded = [_dummies(df, spec.terms) for spec in specs]
    sums: dict[str, Column] = {}
    for m, (spec, (_, columns, _)) in enumerate(zip(specs, coded, strict=True)):
        w = _weight(spec)
        sums |= {f"w{m}": F.sum(w), f"y{m}": F.sum(F.when(w > 0, w * F.col(spec.label)))}
        for j, x in enumerate(columns):
            sums |= {f"s{m}_{j}": F.sum(F.when(w > 0, w * x)), f"q{m}_{j}": F.sum(F.when(w > 0, w * x * x))}
    got = _by_level(df, specs[0].factor, sums)
    states = []
    for m, (spec, (names, columns, levels)) in enumerate(zip(specs, coded, strict=True)):
        rows = [(level, r) for level, r in sorted(got.items(), key=lambda x: x[0]) if r[f"w{m}"]]
        n = sum(r[f"w{m}"] for _, r in rows)
        mean = np.array([sum(r[f"s{m}_{j}"] for _, r in rows) / n if n else 0.0 for j in range(len(names))])
        square = np.array([sum(r[f"q{m}_{j}"] for _, r in rows) / n if n else 0.0 for j in range(len(names))])
        spread = np.maximum(square - mean**2, 0)
        sd = np.where(spread > 1e-12 * np.maximum(square, 1e-300), np.sqrt(spread), 0.0)
        odds = {level: (r[f"y{m}"] or 0.0) / r[f"w{m}"] for level, r in rows}
        open_ = {level: math.log(p / (1 - p)) for level, p in odds.items() if 0 < p < 1}
        closed = {level: -math.inf if p <= 0 else math.inf for level, p in odds.items() if not 0 < p < 1}
        state = _State(spec, names, columns, levels, mean, np.where(sd > 0, sd, 1.0), open_, closed, n)
        state.use = [j for j in range(len(names)) if sd[j] > 0]
        state.beta, state.alpha = np.zeros(len(names)), np.array(list(open_.values()))
        state.done = state.converged = not open_
        states.append(state)
    return states


def _choose(level: Column, values: Mapping[object, float]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return table[level]


def _inputs(s: _State, m: int) -> list[Column]:
    """What a row brings to a model: its place among the open levels, weight, label and terms."""
    level = F.col(s.spec.factor) if s.spec.factor else F.lit("all")
    place = _choose(level, {x: k for k, x in enumerate(s.open_)})
    own = [F.when(_weight(s.spec) > 0, place).alias(f"at{m}"), _weight(s.spec).alias(f"w{m}"), F.col(s.spec.label).cast("double").alias(f"y{m}")]
    return own + [s.columns[j].alias(f"x{m}_{j}") for j in s.use]


def _cross_products(models: Sequence[tuple], width: int):
    """A task's sums per model, level and term, of Arrow batches of ``_inputs``; ``width`` products a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {m: np.zeros((len(alpha), 1 + len(use), 2 + width)) for m, use, alpha, *_ in models}
        for batch in batches:
            for m, use, alpha, beta, mean, sd in models:
                own = batch.filter(pc.is_valid(batch[f"at{m}"]))
                at = own[f"at{m}"].to_numpy(zero_copy_only=False)
                order = np.argsort(at, kind="stable")
                at = at[order]
                w, y = (own[f"{c}{m}"].to_numpy(zero_copy_only=False)[order] for c in "wy")
                x = np.ones((len(order), 1 + len(use)))
                for k, j in enumerate(use):
                    x[:, k + 1] = (own[f"x{m}_{j}"].to_numpy(zero_copy_only=False)[order] - mean[k]) / sd[k]
                e = alpha[at] + x[:, 1:] @ beta
                with np.errstate(over="ignore"):
                    p = 1 / (1 + np.exp(-e))
                # log(1 + exp(e)) without overflow
                fit = w * (y * e - np.maximum(e, 0.0) - np.log1p(np.exp(-np.abs(e))))
                r, v = w * (y - p), w * p * (1 - p)
                edges = np.searchsorted(at, np.arange(len(alpha) + 1))
                for level, (low, high) in enumerate(zip(edges, edges[1:])):
                    if low < high:
                        part, total = x[low:high], sums[m][level]
                        total[:, 0] += part.T @ r[low:high]
                        total[0, 1] += fit[low:high].sum()
                        total[:, 2 : 3 + len(use)] += part.T @ (part * v[low:high, None])
        for m, total in sums.items():
            place, j = np.indices(total.shape[:2]).reshape(2, -1)
            flat = total.reshape(-1, 2 + width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(flat), m), pa.int32()), pa.array(place, pa.int32()), pa.array(j, pa.int32()), *[pa.array(c) for c in flat.T]],
                ["m", "place", "j", "r", "fit", *[f"h{k}" for k in range(width)]],
            )

    return run


def _evaluate(df: DataFrame, states: Sequence[_State]) -> None:
    """Sums of all open models at their current coefficients, in one job, and a step of each.

    The rows are read once for all models, and every task sums its own: the cross-products of a
    batch are products of matrices, so that a row costs no more rows, whatever the terms.
    """
    moving = [(m, s) for m, s in enumerate(states) if not s.done]
    width = 1 + max(len(s.use) for _, s in moving)
    models = [(m, list(s.use), np.array(s.alpha, float), s.beta[s.use], s.mean[s.use], s.sd[s.use]) for m, s in moving]
    sums = ["r", "fit", *[f"h{k}" for k in range(width)]]
    schema = ", ".join(["m int", "place int", "j int", *[f"{c} double" for c in sums]])
    rows = df.select(*[c for m, s in moving for c in _inputs(s, m)])
    each = rows.mapInArrow(_cross_products(models, width), schema).groupBy("m", "place", "j").agg(*[F.sum(c).alias(c) for c in sums])
    got = {(r["m"], r["place"], r["j"]): r for r in each.collect()}
    for m, s in moving:
        size = 1 + len(s.use)
        rows_ = [[got[m, place, j] for j in range(size)] for place in range(len(s.open_))]
        r = np.array([[x["r"] for x in own] for own in rows_])
        h = np.array([[[x[f"h{k}"] for k in range(size)] for x in own] for own in rows_])
        _advance(s, float(sum(own[0]["fit"] for own in rows_)), r, h)


def _advance(s: _State, likelihood: float, score: np.ndarray, information: np.ndarray) -> None:
    """One Newton step from the sums at the current point, or half the last step where that was too long.

    ``score`` is by level and term, ``information`` by level and two terms, intercepts first.
    """
    use, ridge = s.use, s.spec.ridge
    beta = s.beta[use]
    s.steps += 1
    likelihood -= ridge / 2 * float(beta @ beta)
    if s.best is not None and not likelihood >= s.best[0] - 1e-12 * abs(s.best[0]):
        s.step = tuple(x / 2 for x in s.step)
        s.alpha, s.beta = s.best[1] + s.step[0], s.best[2] + s.step[1]
        return
    # the intercepts are eliminated: their part of the information is diagonal
    d, r0, b = np.maximum(information[:, 0, 0], 1e-300), score[:, 0], information[:, 0, 1:]
    h = information[:, 1:, 1:].sum(0) + ridge * np.eye(len(use))
    r = score[:, 1:].sum(0) - ridge * beta
    inner, right = h - b.T @ (b / d[:, None]), r - b.T @ (r0 / d)
    if s.steps == 1:
        kept = _independent(inner, h)
        s.use = [use[k] for k in kept]
        inner, right, b, h, r = inner[np.ix_(kept, kept)], right[kept], b[:, kept], h[np.ix_(kept, kept)], r[kept]
    scale = np.sqrt(np.maximum(np.diag(h), 1e-300))
    s.score = float(max([*np.abs(r / scale), *np.abs(r0 / np.sqrt(d))], default=0.0))
    move = np.zeros(len(s.beta))
    if s.use:
        move[s.use] = np.linalg.lstsq(inner, right, rcond=None)[0]
    shift = (r0 - b @ move[s.use]) / d
    s.best, s.step = (likelihood, s.alpha, s.beta), (shift, move)
    s.alpha, s.beta = s.alpha + shift, s.beta + move


def _independent(inner: np.ndarray, whole: np.ndarray) -> list[int]:
    """Terms, in order, that are not determined by the intercepts and the terms before them."""
    left, kept = inner.copy(), []
    for k in range(len(left)):
        if left[k, k] > ALIASED * max(whole[k, k], 1e-300):
            kept.append(k)
            left = left - np.outer(left[:, k], left[k]) / left[k, k]
    return kept


def fit_models(df: DataFrame, specs: Sequence[ModelSpec], max_iter: int = 60, tol: float = 1e-9) -> list[LogitModel]:
    """Fit several models with one factor over the same rows, together.

    A row takes part in a model where all its terms, the factor, the label and the weight are
    known and the weight is positive.  Levels of the factor without events, or with events
    only, are at the limit of the likelihood from the start and take no part in the rest.  A
    step that lowers the likelihood is halved.  A model has converged when no score is larger
    than ``tol`` standard deviations, or than ``STALLED`` when steps no longer lower it; one
    that does not, as where a term separates the events and ``ridge`` is 0, is returned with a
    warning and ``converged`` False.  ``df`` should be a stage: it is read once per step.
    """
    if len({s.factor for s in specs}) != 1:
        raise ValueError("models that are fitted together need the same factor")
    states = _start(df, specs)
    for _ in range(max_iter):
        if all(s.done for s in states):
            break
        _evaluate(df, states)
        for s in states:
            # below STALLED, a score that a full step no longer halves is rounding
            stalled = s.score <= STALLED and s.score > s.before / 2
            if not s.done and s.best is not None and (s.score <= tol or stalled):
                s.done = s.converged = True
                s.alpha, s.beta = s.best[1], s.best[2]
            s.before = s.score
    return [_finished(s) for s in states]


def _finished(s: _State) -> LogitModel:
    if not s.converged:
        warnings.warn(f"the fit of {s.spec.label} stopped after {s.steps} steps with a score of {s.score:.1e}", stacklevel=3)
    slopes = {s.names[j]: float(s.beta[j] / s.sd[j]) for j in s.use}
    centre = sum(float(s.beta[j] / s.sd[j] * s.mean[j]) for j in s.use)
    intercepts = s.closed | {level: float(a) - centre for level, a in zip(s.open_, s.alpha, strict=True)}
    aliased = tuple(n for j, n in enumerate(s.names) if j not in s.use)
    likelihood = s.best[0] if s.best else 0.0
    return LogitModel(s.spec, intercepts, slopes, s.levels, aliased, s.n, likelihood, s.score if s.best else 0.0, s.steps, s.converged)


def predicted(model: LogitModel) -> Column:
    """The probability a model gives a row; NULL where a term is missing or a level was not seen."""
    spec = model.spec
    level = F.col(spec.factor) if spec.factor else F.lit("all")
    if not model.intercepts:
        return F.lit(None).cast("double")
    known = F.lit(True)
    for c in spec.terms:
        known = known & F.col(c).isNotNull()
        if c in model.levels:
            known = known & F.col(c).isin(*model.levels[c])
    inner = {k: a for k, a in model.intercepts.items() if math.isfinite(a)}
    limits = {k: float(a > 0) for k, a in model.intercepts.items() if not math.isfinite(a)}
    eta = _choose(level, inner) if inner else F.lit(None).cast("double")
    for name, slope in model.coefficients.items():
        term, _, value = name.partition("=")
        x = (F.col(term) == value).cast("double") if term in model.levels else F.col(term).cast("double")
        eta = eta + x * slope
    p = 1 / (1 + F.exp(-eta))
    if limits:
        p = F.coalesce(_choose(level, limits), p)
    return F.when(F.coalesce(known, F.lit(False)), p)
