"""Censoring models, stabilised inverse probability weights and their truncation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialweave.functions.exprs import clamp
from trialweave.functions.running import exact_quantiles
from trialweave.operators.logit import LogitModel, ModelSpec, fit_models, predicted
from trialweave.sources.stages import stage

# Terms of the two censoring models, beside the hour factor.
DENOMINATOR_TERMS = (
    "strategy", "age", "sex", "weight_kg", "charlson_comorbidity_index", "ne_eq_baseline", "mv_baseline",
    "pfratio", "lactate", "ph", "scr_baseline_win", "potassium", "uo_mlkgph_last6h", "map_last1h",
    "vaso_flag_last1h", "ne_eq_last1h", "mv_flag_last1h", "lactate_last6h", "ph_last6h", "k_last6h",
    "scr_last6h",
)
NUMERATOR_TERMS = ("strategy",)
LOWER_TAIL, UPPER_TAIL = 0.01, 0.99


def censor_models(df: DataFrame, specs: Sequence[ModelSpec], merge: bool = False) -> list[LogitModel]:
    """Pooled logistic regressions over clone-hours, fitted together; see ``logit.fit_models``.

    ``merge`` first counts equal rows and fits on the counts, which has the same likelihood;
    use it when all terms are discrete.  ``df`` should be a stage.
    """
    if not merge:
        return fit_models(df, specs)
    if len({(s.label, s.weight) for s in specs}) != 1:
        raise ValueError("merged models need the same label and weight")
    first = specs[0]
    columns = list(dict.fromkeys(c for s in specs for c in (*s.terms, *([s.factor] if s.factor else []), s.label)))
    size = F.sum(first.weight) if first.weight else F.count(F.lit(1)).cast("double")
    counted = stage(df.groupBy(*columns).agg(size.alias("__rows")), "merged-rows")
    fitted = fit_models(counted, [replace(s, weight="__rows") for s in specs])
    return [replace(m, spec=s) for m, s in zip(fitted, specs, strict=True)]


def censor_model(
    df: DataFrame,
    terms: Sequence[str],
    factor: str | None = "hour_index",
    label: str = "censor_k_total",
    weight: str | None = None,
    ridge: float = 0.0,
    merge: bool = False,
) -> LogitModel:
    """One such model."""
    return censor_models(df, [ModelSpec(tuple(terms), factor, label, weight, ridge)], merge)[0]


def predict_hazard(df: DataFrame, model: LogitModel, name: str) -> DataFrame:
    """Add the predicted probability, a column expression.

    Rows with a missing term, or a level that the fit has not seen, have a NULL prediction.
    """
    return df.withColumn(name, predicted(model))


def cell_hazards(
    df: DataFrame, cells: Mapping[str, Sequence[str]], flag: str = "censor_k_total"
) -> DataFrame:
    """Add the mean of ``flag`` in cells of the data: saturated hazard models.

    ``cells`` maps each new column to the columns that define its cells.  Sums are taken once
    over the finest cells; coarser means come from those.  The finest cells are written as a
    stage, so the planner joins them by their real size: broadcast while small, by key
    otherwise.  NULL is a level of its own.
    """
    fine = list(dict.fromkeys(c for by in cells.values() for c in by))
    keys = {c: f"__cell_{c}" for c in fine}
    sums = df.groupBy(*fine).agg(F.sum(flag).alias("__sum"), F.count(flag).alias("__n")).withColumnsRenamed(keys)
    means = {}
    for name, by in cells.items():
        whole = Window.partitionBy(*[keys[c] for c in by])
        means[name] = F.sum("__sum").over(whole) / F.sum("__n").over(whole)
    table = stage(sums, "cells").withColumns(means).drop("__sum", "__n")
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    return df.join(table, same, "left").drop(*keys.values())


def cell_hazard(df: DataFrame, by: Sequence[str], name: str, flag: str = "censor_k_total") -> DataFrame:
    """Add the mean of ``flag`` in each cell of ``by``."""
    return cell_hazards(df, {name: by}, flag)


def stabilized_weights(
    df: DataFrame,
    num: str,
    den: str,
    mode: str = "documented",
    clone_keys: Sequence[str] = ("stay_id", "strategy"),
    order: str = "hour_index",
) -> DataFrame:
    """Per-slice weights and their product along each clone, in slice order.

    ``documented``: (1 - num) / (1 - den).  ``as_coded``: the reciprocal.  A slice whose
    weight is unknown makes the product unknown from there on.  A clone has at most one row
    per slice, which bounds the window.
    """
    if mode not in ("documented", "as_coded"):
        raise ValueError(f"mode must be 'documented' or 'as_coded', not {mode!r}")
    stay_num, stay_den = 1 - F.col(num), 1 - F.col(den)
    out = df.withColumns(
        {
            "w_denom": F.when(stay_den > 0, 1 / stay_den),
            "w_num": F.when(stay_num > 0, 1 / stay_num),
        }
    )
    top, bottom = ("w_denom", "w_num") if mode == "documented" else ("w_num", "w_denom")
    out = out.withColumn("w_slice", F.col(top) / F.col(bottom))
    so_far = Window.partitionBy(*clone_keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    complete = F.count("w_slice").over(so_far) == F.count(F.lit(1)).over(so_far)
    return out.withColumn("ipcw", F.when(complete, F.product("w_slice").over(so_far)))


def truncate_weights(
    df: DataFrame, lo: float = LOWER_TAIL, hi: float = UPPER_TAIL, col: str = "ipcw", name: str = "ipcw_trunc"
) -> DataFrame:
    """Clamp at two exact quantiles taken over all rows, both arms together; NULL stays NULL.

    Runs the quantile jobs now; ``df`` should be a stage.
    """
    bounds = exact_quantiles(df, [col], [lo, hi])
    low, high = (F.lit(bounds[col, p]).cast("double") for p in (lo, hi))
    return df.withColumn(name, clamp(col, low, high))


def last_weight(
    df: DataFrame,
    weight: str = "ipcw_trunc",
    name: str = "ipcw_trunc_last",
    clone_keys: Sequence[str] = ("stay_id", "strategy"),
    order: str = "hour_index",
) -> DataFrame:
    """One row per clone with its weight at its last slice."""
    return df.groupBy(*clone_keys).agg(F.max_by(weight, order).alias(name))
