"""Queries for scans, sinks, expressions, joins, sets and reshaping on plain tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trialweave.functions import exprs as X
from trialweave.functions.running import exact_quantiles, running_sums
from trialweave.operators import cohort, diagnostics, joins
from trialweave.plans import oracle_inputs, proxies  # noqa: F401  (declares the shared subqueries)
from trialweave.plans.proxies import load
from trialweave.plans.registry import oracle, query
from trialweave.sources import (
    TableSpec,
    export,
    load_stage,
    materialize,
    read_csv,
    read_input,
    resolve_source,
    save_stage,
    shared_dir,
    write_csv,
)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks ----------------------------------------------------------------------

_CUSTOMER = T.StructType(
    [
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]
)
_CUSTOMER_SQL = oracle(
    "SELECT * FROM customer", num=["c_acctbal"], plain=["c_custkey", "c_name", "c_mktsegment"]
)


@query("scan_project", oracle("SELECT o_orderkey AS episode, o_custkey AS subject, o_totalprice AS total, o_orderdate AS started FROM orders",
       ts=["started"], num=["total"], plain=["episode", "subject"]))
def scan_project(spark: SparkSession, sf: str) -> DataFrame:
    """Scan with a column mapping; only the four stored columns are read."""
    columns = {"episode": "o_orderkey", "subject": "o_custkey", "total": "o_totalprice", "started": "o_orderdate"}
    return read_input(spark, TableSpec(f"{sf}/orders.parquet", columns))


@query("csv_round_trip", _CUSTOMER_SQL)
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """CSV sink with a header, then CSV scan with a declared schema."""
    path = _folder(spark, "csv")
    write_csv(load(spark, sf, "customer").select(*_CUSTOMER.names), path)
    return read_csv(spark, path, _CUSTOMER)


@query("source_fallback", _CUSTOMER_SQL)
def source_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Preferred file absent, alternative present: the alternative is read."""
    path = _folder(spark, "fallback")
    write_csv(load(spark, sf, "customer").select(*_CUSTOMER.names), path)
    files = {
        "customer": [
            TableSpec(f"{path}-missing", format="csv", schema=_CUSTOMER),
            TableSpec(path, format="csv", schema=_CUSTOMER),
        ]
    }
    return resolve_source(spark, files, {})["customer"]


@query("source_table", oracle("SELECT * FROM part", num=["p_retailprice"], plain=["p_partkey", "p_size"]))
def source_table(spark: SparkSession, sf: str) -> DataFrame:
    """No file present: the input comes from its table."""
    files = {"part": [TableSpec(f"{sf}/part-export.csv", format="csv", schema=_CUSTOMER)]}
    tables = {"part": TableSpec(f"{sf}/part.parquet")}
    return resolve_source(spark, files, tables)["part"].select("p_retailprice", "p_partkey", "p_size")


@query("materialized_stage", oracle("SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey",
       num=["total"], plain=["o_custkey", "n"]))
def materialized_stage(spark: SparkSession, sf: str) -> DataFrame:
    """A stage written twice under one name; the second run replaces the first."""
    path = _folder(spark, "stage")
    orders = load(spark, sf, "orders")
    materialize(orders.select("o_custkey"), "totals", path)
    totals = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return materialize(totals, "totals", path)


@query("stage_versions", oracle("SELECT o_orderkey, o_totalprice, o_totalprice * 2 AS doubled FROM orders",
       num=["o_totalprice", "doubled"], plain=["o_orderkey"]))
def stage_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Save a stage, load it, and save it again with one more column."""
    root = _folder(spark, "stages")
    first = save_stage(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), root, "orders")
    second = save_stage(load_stage(spark, first).withColumn("doubled", F.col("o_totalprice") * 2), root, "orders")
    return load_stage(spark, second)


@query("ordered_export", oracle("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber",
       num=["l_quantity"], plain=["l_orderkey", "l_linenumber"]))
def ordered_export(spark: SparkSession, sf: str) -> DataFrame:
    """Full export in key order (range-partitioned sort), read back."""
    path = _folder(spark, "export")
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    export(lines, ["l_orderkey", "l_linenumber"], path)
    return spark.read.parquet(path).orderBy("l_orderkey", "l_linenumber")


@query("column_subset", oracle("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders", ts=["o_orderdate"], plain=["o_orderkey", "o_orderstatus"]))
def column_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Columns pulled back for an analysis; the others are never read."""
    return load(spark, sf, "orders").select("o_orderdate", "o_orderkey", "o_orderstatus")


# --- projections, filters, expressions -------------------------------------------------------

@query("rename_columns", oracle("SELECT c_custkey AS subject_id, c_acctbal AS balance FROM customer", num=["balance"], plain=["subject_id"]))
def rename_columns(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select("c_custkey", "c_acctbal").withColumnsRenamed(
        {"c_custkey": "subject_id", "c_acctbal": "balance"}
    )


@query("code_match", oracle("""SELECT * FROM icd WHERE (icd_version = 10 AND icd_code = '1-URGENT/0')
    OR (icd_version = 9 AND icd_code IN ('2-HIGH/1', '5-LOW/2'))""", plain=["subject_id", "icd_version", "icd_code"]))
def code_match(spark: SparkSession, sf: str) -> DataFrame:
    """Code lists that depend on the coding version."""
    codes = proxies.tables(spark, sf)["diagnoses_icd"]
    return codes.filter(X.code_match("icd_version", "icd_code", proxies.CODES))


@query("null_predicates", oracle("""SELECT count(*) FILTER (WHERE sepsis3 IS TRUE) AS confirmed,
    count(*) FILTER (WHERE sepsis3 IS NOT TRUE) AS other, (SELECT count(*) FROM wt WHERE weight IS NULL) AS no_weight,
    (SELECT count(*) FROM adm WHERE deathtime IS NOT NULL) AS died FROM infection""", plain=["confirmed", "other", "no_weight", "died"]))
def null_predicates(spark: SparkSession, sf: str) -> DataFrame:
    t = proxies.tables(spark, sf)
    confirmed = F.col("sepsis3").eqNullSafe(True)
    return t["sepsis3"].agg(
        F.count_if(confirmed).alias("confirmed"),
        F.count_if(~confirmed).alias("other"),
    ).withColumns(
        {
            "no_weight": t["weight_durations"].filter(F.col("weight").isNull()).agg(F.count(F.lit(1))).scalar(),
            "died": t["admissions"].filter(F.col("deathtime").isNotNull()).agg(F.count(F.lit(1))).scalar(),
        }
    )


@query("range_filter", oracle("""SELECT u.stay_id, s.suspected_infection_time FROM units u JOIN infection s ON s.stay_id = u.stay_id
    WHERE s.suspected_infection_time >= u.intime AND s.suspected_infection_time <= u.outtime""",
    ts=["suspected_infection_time"], plain=["stay_id"]))
def range_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Inclusive range whose bounds come from another table."""
    t = proxies.tables(spark, sf)
    both = t["units"].join(t["sepsis3"], "stay_id")
    inside = F.col("suspected_infection_time").between(F.col("intime"), F.col("outtime"))
    return both.filter(inside).select("stay_id", "suspected_infection_time")


@query("any_positive", oracle("""SELECT event_id, coalesce(dose, 0) > 0 OR coalesce(vasopressin, 0) > 0 AS given FROM drug""", plain=["event_id", "CAST(given AS INTEGER) AS given"]))
def any_positive(spark: SparkSession, sf: str) -> DataFrame:
    drug = proxies.tables(spark, sf)["vasoactive_agent"]
    names = ("norepinephrine", "epinephrine", "phenylephrine", "vasopressin", "dopamine")
    return drug.select("event_id", X.flag(X.any_positive(*names)).alias("given"))


@query("active_or_mode", oracle("SELECT event_id FROM crrt WHERE coalesce(system_active, 0) = 1 OR crrt_mode IS NOT NULL", plain=["event_id"]))
def active_or_mode(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.tables(spark, sf)["crrt"].filter(X.active_or_mode("system_active", "crrt_mode")).select("event_id")


@query("either_flag", oracle("SELECT stay_id, count(*) AS n FROM rrt WHERE dialysis_present = 1 OR dialysis_active = 1 GROUP BY stay_id", plain=["stay_id", "n"]))
def either_flag(spark: SparkSession, sf: str) -> DataFrame:
    rows = proxies.tables(spark, sf)["rrt"].filter(X.either_flag("dialysis_present", "dialysis_active"))
    return rows.groupBy("stay_id").agg(F.count(F.lit(1)).alias("n"))


@query("guarded_ratio", oracle("""SELECT event_id, CASE WHEN pao2 IS NOT NULL AND fio2 IS NOT NULL AND fio2 > 0 THEN pao2 / fio2 END AS pf_ratio
    FROM lab""", num=["pf_ratio"], plain=["event_id"]))
def guarded_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.tables(spark, sf)["bg"].select("event_id", X.guarded_ratio("po2", "fio2").alias("pf_ratio"))


@query("weight_rate", oracle("""SELECT u.stay_id, CASE WHEN w.weight IS NULL OR w.weight <= 0 THEN NULL ELSE u.total / w.weight / 6.0 END AS rate
    FROM (SELECT stay_id, sum(urineoutput) AS total FROM urine GROUP BY stay_id) u JOIN wt w ON w.stay_id = u.stay_id""",
    num=["rate"], plain=["stay_id"]))
def weight_rate(spark: SparkSession, sf: str) -> DataFrame:
    t = proxies.tables(spark, sf)
    totals = t["urine_output"].groupBy("stay_id").agg(F.sum("urineoutput").alias("total"))
    return totals.join(t["weight_durations"], "stay_id").select(
        "stay_id", X.rate_per_weight("total", "weight", 6).alias("rate")
    )


@query("greatest_skip_null", oracle("""SELECT u.stay_id, greatest(u.intime, a.deathtime) AS latest FROM units u JOIN adm a ON a.hadm_id = u.hadm_id""",
    ts=["latest"], plain=["stay_id"]))
def greatest_skip_null(spark: SparkSession, sf: str) -> DataFrame:
    t = proxies.tables(spark, sf)
    return t["units"].join(t["admissions"], "hadm_id").select("stay_id", F.greatest("intime", "deathtime").alias("latest"))


@query("shift_times", oracle("""SELECT o_orderkey, o_orderdate - INTERVAL 6 HOUR AS six_before, o_orderdate + INTERVAL 28 DAY AS follow_up FROM orders""",
    ts=["six_before", "follow_up"], plain=["o_orderkey"]))
def shift_times(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select(
        X.plus_hours("o_orderdate", -6).alias("six_before"), X.plus_days("o_orderdate", 28).alias("follow_up"), "o_orderkey"
    )


@query("hour_offset", oracle("""SELECT l_orderkey, l_linenumber, l_shipdate + to_hours(CAST(l_linenumber AS INTEGER)) AS shifted FROM lineitem""",
    ts=["shifted"], plain=["l_orderkey", "l_linenumber"]))
def hour_offset(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select(
        X.plus_hours("l_shipdate", F.col("l_linenumber")).alias("shifted"), "l_orderkey", "l_linenumber"
    )


@query("days_between", oracle("""SELECT u.stay_id, (epoch_us(a.deathtime) - epoch_us(u.intime)) / 86400000000.0 AS days
    FROM units u JOIN adm a ON a.hadm_id = u.hadm_id""", num=["days"], plain=["stay_id"]))
def days_between(spark: SparkSession, sf: str) -> DataFrame:
    t = proxies.tables(spark, sf)
    return t["units"].join(t["admissions"], "hadm_id").select("stay_id", X.days_between("intime", "deathtime").alias("days"))


@query("clamp_null", oracle("""SELECT event_id, CASE WHEN lactate IS NOT NULL THEN least(greatest(lactate, 1.0), 8.0) END AS low_high,
    CASE WHEN lactate IS NOT NULL AND fio2 IS NOT NULL THEN least(lactate, fio2) END AS capped FROM lab""",
    num=["low_high", "capped"], plain=["event_id"]))
def clamp_null(spark: SparkSession, sf: str) -> DataFrame:
    """Clamp with constant and with column bounds; any missing input gives NULL."""
    return proxies.tables(spark, sf)["bg"].select(
        "event_id", X.clamp("lactate", 1.0, 8.0).alias("low_high"), X.clamp("lactate", hi=F.col("fio2")).alias("capped")
    )


@query("event_flag", oracle("""SELECT stay_id, strategy, event_v FROM (SELECT o.stay_id, s.strategy,
    CASE WHEN o.death_28d = 1 AND (epoch_us(o.deathtime) - epoch_us(o.t0_time)) / 86400000000.0 <= 28 THEN 1 ELSE 0 END AS event_v
    FROM outc o CROSS JOIN (VALUES ('A'), ('B')) s(strategy)) q""", plain=["stay_id", "strategy", "event_v"]))
def event_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Three-valued condition: an unknown time with a known 'no' is a 0."""
    s = proxies.study(spark, sf)
    c = proxies.relaxed_cohort(s).join(s.tables["admissions"].select("hadm_id", "deathtime"), "hadm_id")
    died = (F.col("deathtime") > F.col("t0_time")) & (X.days_between("t0_time", "deathtime") <= 28)
    return joins.clone(c, ("A", "B")).select("stay_id", "strategy", X.flag(died).alias("event_v"))


@query("band_labels", oracle("""SELECT event_id, CASE WHEN lactate IS NULL THEN 'missing' WHEN lactate < 2 THEN 'low' WHEN lactate < 4 THEN 'mid' ELSE 'high' END AS label
    FROM lab""", plain=["event_id", "label"]))
def band_labels(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.tables(spark, sf)["bg"].select(
        "event_id", X.band("lactate", (2.0, 4.0), ("low", "mid", "high")).alias("label")
    )


@query("stage_pathway", oracle("""SELECT event_id, CASE WHEN aki_stage = 3 AND aki_stage_creat < 3 THEN 'uo_driven'
    WHEN aki_stage < 3 AND aki_stage_creat = 3 THEN 'scr_driven' WHEN aki_stage = 3 AND aki_stage_creat = 3 THEN 'mixed' ELSE 'unknown' END AS pathway
    FROM stg""", plain=["event_id", "pathway"]))
def stage_pathway(spark: SparkSession, sf: str) -> DataFrame:
    """Classification from two stage components."""
    labels = ("uo_driven", "scr_driven", "mixed", "unknown")
    return proxies.tables(spark, sf)["kdigo_stages"].select(
        "event_id", X.driven_by("aki_stage_uo", "aki_stage_creat", labels).alias("pathway")
    )


@query("clone_key", oracle("SELECT stay_id || '_' || strategy AS clone_id FROM units CROSS JOIN (VALUES ('A'), ('B')) s(strategy)", plain=["clone_id"]))
def clone_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = joins.clone(proxies.tables(spark, sf)["units"].select("stay_id"), ("A", "B"))
    return rows.select(X.composite_key("stay_id", "strategy").alias("clone_id"))


@query("label_strip", oracle("""SELECT 'segment=' || c_mktsegment AS label, c_mktsegment AS stripped, count(*) AS n FROM customer GROUP BY ALL""",
    plain=["label", "stripped", "n"]))
def label_strip(spark: SparkSession, sf: str) -> DataFrame:
    """Build a labelled level and strip its prefix again."""
    labelled = load(spark, sf, "customer").select(F.concat(F.lit("segment="), "c_mktsegment").alias("label"))
    return labelled.groupBy("label", X.strip_prefix("label").alias("stripped")).agg(F.count(F.lit(1)).alias("n"))


@query("literal_columns", oracle("SELECT n_nationkey, 1 AS step_order, 'core' AS step_label FROM nation", plain=["n_nationkey", "step_order", "step_label"]))
def literal_columns(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "nation").select(
        "n_nationkey", F.lit(1).alias("step_order"), F.lit("core").alias("step_label")
    )


@query("drop_nulls", oracle("SELECT event_id, lactate, fio2 FROM lab WHERE lactate IS NOT NULL AND fio2 IS NOT NULL", num=["lactate", "fio2"], plain=["event_id"]))
def drop_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.tables(spark, sf)["bg"].select("event_id", "lactate", "fio2").dropna(subset=["lactate", "fio2"])


@query("filter_level", oracle("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY'", plain=["c_custkey", "c_mktsegment"]))
def filter_level(spark: SparkSession, sf: str) -> DataFrame:
    """Equality filter on a column named at run time; it is pushed to the scan."""
    column, level = "c_mktsegment", "MACHINERY"
    return load(spark, sf, "customer").filter(F.col(column) == level).select("c_custkey", column)


@query("cast_types", oracle("SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS subject, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 2.0 ELSE 3.0 END AS arm FROM orders",
    num=["arm"], plain=["o_orderkey", "subject"]))
def cast_types(spark: SparkSession, sf: str) -> DataFrame:
    """Integer cast, and a category as a number by the order of its levels."""
    arm = F.array_position(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("o_orderstatus"))
    return load(spark, sf, "orders").select(
        arm.cast("double").alias("arm"), "o_orderkey", F.col("o_custkey").cast("int").alias("subject")
    )


# --- joins -----------------------------------------------------------------------------------

@query("inner_join", oracle("SELECT o.o_orderkey, c.c_mktsegment FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey", plain=["o_orderkey", "c_mktsegment"]))
def inner_join(spark: SparkSession, sf: str) -> DataFrame:
    people = load(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return load(spark, sf, "orders").join(people, "o_custkey", "inner").select("o_orderkey", "c_mktsegment")


@query("left_join", oracle("""SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'""",
    num=["o_totalprice"], plain=["c_custkey", "o_orderkey"]))
def left_join(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").filter(F.col("o_orderstatus") == "P").withColumnRenamed("o_custkey", "c_custkey")
    return joins.left_join(load(spark, sf, "customer").select("c_custkey"), orders, "c_custkey", ["o_totalprice", "o_orderkey"])


@query("anti_join", oracle("""SELECT c.c_custkey FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') o
    ON o.o_custkey = c.c_custkey WHERE o.o_custkey IS NULL""", plain=["c_custkey"]))
def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    urgent = load(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").withColumnRenamed("o_custkey", "c_custkey")
    return joins.exclude(load(spark, sf, "customer"), urgent, "c_custkey").select("c_custkey")


@query("presence_join", oracle("""SELECT c.c_custkey FROM customer c JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') o
    ON o.o_custkey = c.c_custkey""", plain=["c_custkey"]))
def presence_join(spark: SparkSession, sf: str) -> DataFrame:
    urgent = load(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").withColumnRenamed("o_custkey", "c_custkey")
    return joins.require(load(spark, sf, "customer"), urgent, "c_custkey").select("c_custkey")


@query("clone_rows", oracle("SELECT o_orderkey, strategy FROM orders CROSS JOIN (VALUES ('A'), ('B')) s(strategy)", plain=["o_orderkey", "strategy"]))
def clone_rows(spark: SparkSession, sf: str) -> DataFrame:
    return joins.clone(load(spark, sf, "orders").select("o_orderkey"), ("A", "B"))


# --- aggregates, windows, order --------------------------------------------------------------

@query("row_count", oracle("SELECT count(*) AS n FROM lineitem", plain=["n"]))
def row_count(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("min_by_key", oracle("SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_orderkey", ts=["first_ship"], plain=["l_orderkey"]))
def min_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship")).select("first_ship", "l_orderkey")


@query("distinct_keys", oracle("SELECT DISTINCT l_suppkey FROM lineitem", plain=["l_suppkey"]))
def distinct_keys(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select("l_suppkey").distinct()


@query("distinct_levels", oracle("SELECT DISTINCT lactate_2grp AS level FROM sub_flags", plain=["level"]))
def distinct_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Levels of a subgroup column."""
    s = proxies.study(spark, sf)
    return s.subgroups(s.baseline(proxies.relaxed_cohort(s))).select(F.col("lactate_2grp").alias("level")).distinct()


@query("group_size_gate", oracle("""SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12""", plain=["o_custkey", "n"]))
def group_size_gate(spark: SparkSession, sf: str) -> DataFrame:
    sizes = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return sizes.filter(F.col("n") >= 12)


@query("quantiles_exact", oracle("""SELECT quantile_cont(o_totalprice, 0.01) AS q01, quantile_cont(o_totalprice, 0.5) AS q50,
    quantile_cont(o_totalprice, 0.99) AS q99, (SELECT quantile_cont(lactate, 0.99) FROM lab) AS lactate99 FROM orders""", num=["q01", "q50", "q99", "lactate99"]))
def quantiles_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Exact interpolated quantiles by bracketing, NULLs skipped."""
    probs = (0.01, 0.5, 0.99)
    orders = load(spark, sf, "orders")
    q = exact_quantiles(orders, ["o_totalprice"], probs, small=2000, accuracy=500)
    lactate = exact_quantiles(proxies.tables(spark, sf)["bg"], ["lactate"], [0.99])
    return orders.groupBy().agg(
        *[F.lit(q["o_totalprice", p]).alias(name) for p, name in zip(probs, ("q01", "q50", "q99"))],
        F.lit(lactate["lactate", 0.99]).alias("lactate99"),
    )


@query("six_number_summary", oracle("""SELECT min(lactate) AS min, quantile_cont(lactate, 0.25) AS q1, quantile_cont(lactate, 0.5) AS median,
    avg(lactate) AS mean, quantile_cont(lactate, 0.75) AS q3, max(lactate) AS max, count(*) - count(lactate) AS n_missing FROM lab""",
    num=["min", "q1", "median", "mean", "q3", "max"], plain=["n_missing"]))
def six_number_summary(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.six_number_summary(proxies.tables(spark, sf)["bg"], "lactate")


@query("first_row_per_key", oracle("""SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER
    (PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, o_orderkey) AS rn FROM orders) q WHERE rn = 1""", ts=["o_orderdate"], plain=["o_custkey", "o_orderkey"]))
def first_row_per_key(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_orderdate", "o_custkey", "o_orderkey")
    return cohort.first_per_key(orders, "o_custkey", "o_orderdate", "o_orderkey")


@query("cumulative_product", oracle("""SELECT l_orderkey, l_linenumber, product(1 - l_discount) OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kept FROM lineitem""", num=["kept"], plain=["l_orderkey", "l_linenumber"]))
def cumulative_product(spark: SparkSession, sf: str) -> DataFrame:
    along = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"
    ).rowsBetween(Window.unboundedPreceding, 0)
    kept = F.product(1 - F.col("l_discount")).over(along)
    return load(spark, sf, "lineitem").select(kept.alias("kept"), "l_orderkey", "l_linenumber")


@query("risk_set_sums", oracle("""SELECT l_returnflag, day, sum(qty) OVER (PARTITION BY l_returnflag ORDER BY day DESC ROWS UNBOUNDED PRECEDING) AS at_risk
    FROM (SELECT l_returnflag, epoch_us(l_shipdate) // 86400000000 AS day, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL) q""", num=["at_risk"], plain=["l_returnflag", "day"]))
def risk_set_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Reverse running sum per group over distinct days, in buckets of 64 days."""
    day = X.floor_div(X.micros_between(F.lit("1970-01-01").cast("timestamp_ntz"), "l_shipdate"), X.DAY_US)
    days = load(spark, sf, "lineitem").groupBy("l_returnflag", day.alias("day")).agg(F.sum("l_quantity").alias("qty"))
    return running_sums(days, ["l_returnflag"], "day", {"at_risk": "qty"}, descending=True, width=64).select(
        "at_risk", "l_returnflag", "day"
    )


@query("step_lengths", oracle("""SELECT o_custkey, day, lead(day, 1, 12000) OVER (PARTITION BY o_custkey ORDER BY day) - day AS gap
    FROM (SELECT DISTINCT o_custkey, epoch_us(o_orderdate) // 86400000000 AS day FROM orders) q""", plain=["o_custkey", "day", "gap"]))
def step_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Time from each distinct day to the next one of the same key, the last one to a fixed end."""
    day = X.floor_div(X.micros_between(F.lit("1970-01-01").cast("timestamp_ntz"), "o_orderdate"), X.DAY_US)
    days = load(spark, sf, "orders").select("o_custkey", day.alias("day")).distinct()
    following = F.lead("day", 1, 12000).over(Window.partitionBy("o_custkey").orderBy("day"))
    return days.select("o_custkey", "day", (following - F.col("day")).alias("gap"))


@query("ecdf_rank", oracle("""SELECT DISTINCT l_returnflag, l_quantity, cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS ecdf FROM lineitem""",
    num=["l_quantity", "ecdf"], plain=["l_returnflag"]))
def ecdf_rank(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.ecdf(load(spark, sf, "lineitem"), "l_quantity", "l_returnflag").select(
        "l_quantity", "ecdf", "l_returnflag"
    )


# --- sets and reshaping ----------------------------------------------------------------------

@query("union_distinct", oracle("""SELECT stay_id FROM rrt WHERE dialysis_present = 1 OR dialysis_active = 1 UNION
    SELECT stay_id FROM crrt WHERE system_active = 1 OR crrt_mode IS NOT NULL""", plain=["stay_id"]))
def union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    t = proxies.tables(spark, sf)
    a = t["rrt"].filter(X.either_flag("dialysis_present", "dialysis_active")).select("stay_id")
    b = t["crrt"].filter(X.active_or_mode("system_active", "crrt_mode")).select("stay_id")
    return a.union(b).distinct()


@query("union_all_labels", oracle("""SELECT 'customers' AS step_label, count(*) AS n_value FROM customer UNION ALL
    SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lines', count(*) FROM lineitem""", plain=["step_label", "n_value"]))
def union_all_labels(spark: SparkSession, sf: str) -> DataFrame:
    sizes = {"customers": "customer", "orders": "orders", "lines": "lineitem"}
    return joins.union_labelled(
        [(label, load(spark, sf, t).agg(F.count(F.lit(1)).alias("n_value"))) for label, t in sizes.items()]
    )


@query("row_bind", oracle("""SELECT 'customer' AS source, c_nationkey AS nation, avg(c_acctbal) AS mean FROM customer GROUP BY c_nationkey UNION ALL
    SELECT 'supplier', s_nationkey, avg(s_acctbal) FROM supplier GROUP BY s_nationkey""", num=["mean"], plain=["source", "nation"]))
def row_bind(spark: SparkSession, sf: str) -> DataFrame:
    """Stack result frames of the same shape."""
    parts = []
    for table, p in (("customer", "c"), ("supplier", "s")):
        df = load(spark, sf, table).groupBy(F.col(f"{p}_nationkey").alias("nation")).agg(F.avg(f"{p}_acctbal").alias("mean"))
        parts.append((table, df.select("mean", "nation")))
    return joins.union_labelled(parts, "source").select("mean", "source", "nation")


@query("unpivot_long", oracle("""SELECT l_orderkey, l_linenumber, type, weight FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem)
    UNPIVOT (weight FOR type IN (l_discount, l_tax))""", num=["weight"], plain=["l_orderkey", "l_linenumber", "type"]))
def unpivot_long(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    long = lines.unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "type", "weight")
    return long.select("weight", "l_orderkey", "l_linenumber", "type")


@query("pivot_wide", oracle("""SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS "F",
    sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS "O",
    sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS "P" FROM orders GROUP BY o_custkey""", num=['"F"', '"O"', '"P"'], plain=["o_custkey"]))
def pivot_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Long to wide with declared levels, so that no extra job looks for them."""
    wide = load(spark, sf, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice"))
    return wide.select("F", "O", "P", "o_custkey")
