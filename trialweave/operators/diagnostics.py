"""Censoring rates, weight summaries and the tables behind distribution plots."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.functions.running import exact_quantiles, running_counts
from trialweave.sources.stages import stage


def censor_rate(df: DataFrame, by: Sequence[str] = ("hour_index",), flag: str = "censor_k_total") -> DataFrame:
    """Mean of a 0/1 column and number of rows per group."""
    return df.groupBy(*by).agg(F.avg(flag).alias("censor_rate"), F.count(F.lit(1)).alias("n"))


def weight_summary(df: DataFrame, raw: str = "ipcw", trunc: str = "ipcw_trunc") -> DataFrame:
    """One row: n, then mean, sd, p50, p95, p99 and max of raw and truncated weights.

    Rows with either weight missing are left out.  Runs quantile jobs; ``df`` should be a stage.
    """
    known = df.select(raw, trunc).dropna()
    probs = (0.5, 0.95, 0.99)
    q = exact_quantiles(known, [raw, trunc], probs)
    aggs = [F.count(F.lit(1)).alias("n")]
    for col, tag in ((raw, "raw"), (trunc, "trunc")):
        aggs += [
            F.avg(col).alias(f"mean_{tag}"),
            F.stddev_samp(col).alias(f"sd_{tag}"),
            *[F.lit(q[col, p]).cast("double").alias(f"p{int(p * 100)}_{tag}") for p in probs],
            F.max(col).alias(f"max_{tag}"),
        ]
    return known.agg(*aggs)


def six_number_summary(df: DataFrame, col: str) -> DataFrame:
    """Minimum, quartiles, mean, maximum and number of missing values of one column."""
    q = exact_quantiles(df, [col], (0.25, 0.5, 0.75))
    return df.agg(
        F.min(col).alias("min"),
        F.lit(q[col, 0.25]).cast("double").alias("q1"),
        F.lit(q[col, 0.5]).cast("double").alias("median"),
        F.avg(col).alias("mean"),
        F.lit(q[col, 0.75]).cast("double").alias("q3"),
        F.max(col).alias("max"),
        F.count_if(F.col(col).isNull()).alias("n_missing"),
    )


def weights_long(df: DataFrame, cols: Sequence[str] = ("ipcw", "ipcw_trunc")) -> DataFrame:
    """(type, weight) rows of the complete pairs."""
    return df.select(*cols).dropna().unpivot([], list(cols), "type", "weight")


def histogram(df: DataFrame, col: str, bins: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """Counts in ``bins`` equal-width bins between the extremes of each group.

    Bins are closed on the left, the last one on both sides; empty bins are listed with 0.
    """
    by = list(by)
    ends = stage(df.groupBy(*by).agg(F.min(col).alias("lo"), F.max(col).alias("hi")), "ends")
    known = df.filter(F.col(col).isNotNull()).select(*by, col)
    # Group extremes are one row per group; written as a stage they are joined by real size.
    joined = known.join(ends, by, "inner") if by else known.withColumns(
        {c: ends.select(c).scalar() for c in ("lo", "hi")}
    )
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(width > 0, F.least(F.floor((F.col(col) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    counts = joined.groupBy(*by, (bin_ + 1).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = ends.filter(F.col("lo").isNotNull()).select(
        *by, "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")
    )
    step = (F.col("hi") - F.col("lo")) / bins
    return every.join(counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("lo") + step * (F.col("bin") - 1)).alias("bin_start"),
        (F.col("lo") + step * F.col("bin")).alias("bin_end"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def ecdf(df: DataFrame, col: str = "weight", by: str = "type") -> DataFrame:
    """Share of values at or below each distinct value, per group."""
    counts = stage(
        df.filter(F.col(col).isNotNull()).groupBy(by, col).agg(F.count(F.lit(1)).alias("n")), "value-counts"
    )
    summed = running_counts(counts, [by], col, "n", "n_below")
    totals = stage(counts.groupBy(by).agg(F.sum("n").alias("total")), "totals")
    return summed.join(totals, by, "inner").select(by, col, (F.col("n_below") / F.col("total")).alias("ecdf"))


def density(
    df: DataFrame, col: str = "weight", by: str = "type", points: int = 512, digits: int = 3
) -> DataFrame:
    """Gaussian kernel density of log10(value) per group on an even grid between its extremes.

    Values are first counted on a log10 grid of ``digits`` decimals, whose size depends on
    the range of the values and not on their number; the kernel sum runs over those counts.
    Groups are few (raw and truncated weights); their bandwidths are computed now.
    """
    logs = df.filter(F.col(col) > 0).select(by, F.round(F.log10(col), digits).alias("x"))
    counts = stage(logs.groupBy(by, "x").agg(F.count(F.lit(1)).alias("n")), "log-counts")
    moments = counts.groupBy(by).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("x")).alias("s"),
        F.sum(F.col("n") * F.col("x") * F.col("x")).alias("ss"),
        F.min("x").alias("lo"),
        F.max("x").alias("hi"),
        F.percentile("x", F.lit([0.25, 0.75]), F.col("n")).alias("q"),
    )
    variance = F.greatest((F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0))
    sd = F.when(F.col("n") > 1, F.sqrt(variance)).otherwise(0.0)
    iqr = (F.col("q")[1] - F.col("q")[0]) / 1.34
    spread = F.least(sd, iqr)
    spread = F.when(spread > 0, spread).when(sd > 0, sd).otherwise(1.0)
    scale = stage(
        moments.select(by, "n", "lo", "hi", (0.9 * spread * F.pow("n", F.lit(-0.2))).alias("bw")).withColumnRenamed(
            "n", "total"
        ),
        "scale",
    )
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    terms = counts.join(scale, by, "inner").withColumn("i", grid).withColumn("at", F.col("lo") + step * F.col("i"))
    z = (F.col("at") - F.col("x")) / F.col("bw")
    kernel = F.exp(-z * z / 2) / (F.col("bw") * F.col("total") * math.sqrt(2 * math.pi))
    return terms.groupBy(by, "i").agg(F.first("at").alias("log10_weight"), F.sum(F.col("n") * kernel).alias("density"))
