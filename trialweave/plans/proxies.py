"""Proxy inputs of the study over the synthetic test tables.

``stay_id`` is a user's fortnight, with its time run eight times as fast so that an hour holds
enough events; ``subject_id`` joins every second fortnight of a user.  Every rule below is repeated,
independently, in the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.functions.exprs import DAY_US, days_between, floor_div, micros_between, plus_hours
from trialweave.operators.cohort import Eligibility, time_zero
from trialweave.plans.study import Params, Study
from trialweave.sources.stages import stage
from trialweave.sources.tables import TableSpec, read_input

# Fixed values of the proxies: first day of the events, and the excluded codes.
START = "2024-01-01 00:00:00"
PART_DAYS, SPEED = 14, 8
CODES = {10: ("1-URGENT/0",), 9: ("2-HIGH/1", "5-LOW/2")}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_input(spark, TableSpec(f"{sf_dir}/{name}.parquet"))


def _seconds(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit(START).cast("timestamp_ntz")
    since = micros_between(start, "ts")
    part = floor_div(since, PART_DAYS * DAY_US)
    opens = part * (PART_DAYS * DAY_US)
    return load(spark, sf_dir, "events").select(
        "event_id", F.timestamp_add("MICROSECOND", opens + floor_div(since - opens, SPEED), start).alias("ts"), "user_id",
        (F.col("user_id") * 2 + part % 2).alias("subject_id"), "event_type", "value", (F.col("user_id") * 100 + part).alias("stay_id"),
    )


def units(ev: DataFrame, customer: DataFrame) -> DataFrame:
    spans = ev.groupBy("stay_id", "user_id", "subject_id").agg(F.min("ts").alias("intime"), F.max("ts").alias("outtime"))
    people = customer.select(
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("M").alias("gender"),
        F.concat(F.lit("R"), (F.col("c_nationkey") % 5).cast("string")).alias("race"),
    )
    return spans.join(people, "user_id", "left").select(
        "stay_id",
        "subject_id",
        F.col("stay_id").alias("hadm_id"),
        "intime",
        "outtime",
        (10 + F.col("user_id") % 80).cast("double").alias("age"),
        "gender",
        "race",
        days_between("intime", "outtime").alias("los_icu"),
    )


def admissions(ev: DataFrame, customer: DataFrame) -> DataFrame:
    spans = ev.groupBy("stay_id", "user_id").agg(F.min("ts").alias("intime"))
    deaths = (
        ev.filter((F.col("event_type") == "signup") & (F.col("value") > 100))
        .groupBy("user_id").agg(F.max("ts").alias("died"))
    )
    people = customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("insurance"))
    return (
        spans.join(deaths, "user_id", "left")
        .join(people, "user_id", "left")
        .select(
            F.col("stay_id").alias("hadm_id"),
            "insurance",
            plus_hours("intime", -24).alias("admittime"),
            F.when(F.col("died") >= F.col("intime"), F.col("died")).alias("deathtime"),
        )
    )


def _of(ev: DataFrame, *types: str) -> DataFrame:
    return ev.filter(F.col("event_type").isin(*types))


class Inputs(Mapping[str, DataFrame]):
    """Input tables by name, each planned when first asked for."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders, self._built = dict(builders), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def tables(spark: SparkSession, sf_dir: str, staged: bool = False) -> Inputs:
    """The inputs by name; ``staged`` first writes the events, for a query that reads most of them."""
    ev = events(spark, sf_dir)
    ev = stage(ev, "events") if staged else ev
    customer = load(spark, sf_dir, "customer")
    i, v, ts = F.col("event_id"), F.col("value"), F.col("ts")
    # some times are unknown
    charted = F.when(i % 37 != 0, ts).alias("charttime")
    started = F.when(i % 41 != 0, ts).alias("starttime")
    # drugs run for an hour when they are charted
    running = F.when(i % 41 != 0, plus_hours(ts, -1)).alias("starttime")
    point = [F.col("stay_id"), charted, i]
    episode = [F.col("stay_id").alias("hadm_id"), charted, i]
    rate = F.when(i % 12 != 0, v / 100)
    drug_end = F.when(i % 10 != 0, ts + _seconds(F.round(v * 1200)))
    return Inputs({
        "units": lambda: units(ev, customer),
        "admissions": lambda: admissions(ev, customer),
        "sepsis3": lambda: _of(ev, "signup", "view", "click", "purchase").groupBy("stay_id").agg(F.min("ts").alias("suspected_infection_time")).withColumn(
            "sepsis3", F.col("stay_id") % 11 != 0
        ),
        "weight_durations": lambda: units(ev, customer).select(
            "stay_id",
            plus_hours("intime", -1).alias("starttime"),
            F.when(F.col("subject_id") % 7 != 0, F.col("outtime")).alias("endtime"),
            F.when(F.col("subject_id") % 23 != 0, (50 + F.col("subject_id") % 60).cast("double")).alias("weight"),
        ),
        "diagnoses_icd": lambda: load(spark, sf_dir, "orders").select(
            F.col("o_custkey").alias("subject_id"),
            F.when(F.col("o_orderstatus") == "P", 10).when(F.col("o_orderstatus") == "F", 9).alias("icd_version"),
            F.concat(F.col("o_orderpriority"), F.lit("/"), (F.col("o_orderkey") % 16).cast("string")).alias("icd_code"),
        ),
        "kdigo_stages": lambda: _of(ev, "error").select(
            *point,
            (1 + i % 3).cast("int").alias("aki_stage"),
            (1 + i % 3).cast("int").alias("aki_stage_uo"),
            (1 + floor_div(i, 3) % 3).cast("int").alias("aki_stage_creat"),
        ),
        "vasoactive_agent": lambda: _of(ev, "click", "purchase", "view", "signup").select(
            "stay_id", running, drug_end.alias("endtime"), i,
            rate.alias("norepinephrine"),
            F.when(i % 8 == 0, F.lit(0.0)).alias("epinephrine"),
            F.lit(None).cast("double").alias("phenylephrine"),
            F.when(i % 8 == 4, v / 50).alias("vasopressin"),
            F.lit(None).cast("double").alias("dopamine"),
        ),
        "norepinephrine_equivalent_dose": lambda: _of(ev, "click", "purchase", "view", "signup").select(
            "stay_id", running, drug_end.alias("endtime"), i, rate.alias("norepinephrine_equivalent_dose")
        ),
        "ventilation": lambda: _of(ev, "view").filter(i % 2 == 0).select(
            "stay_id", started, (ts + _seconds(F.round(v * 300))).alias("endtime"), i
        ),
        "rrt": lambda: _of(ev, "purchase").select(
            *point,
            F.when(i % 20 == 0, 1).alias("dialysis_present"),
            F.when(i % 22 == 0, 1).otherwise(0).alias("dialysis_active"),
        ),
        "crrt": lambda: _of(ev, "purchase").select(
            *point, (i % 14 == 1).cast("int").alias("system_active"), F.when(i % 18 == 0, "CVVH").alias("crrt_mode")
        ),
        "vitalsign": lambda: ev.select(
            *point,
            (60 + v / 10).alias("heart_rate"),
            (100 + v / 5).alias("sbp"),
            (50 + v / 8).alias("dbp"),
            F.when(i % 15 != 0, 40 + v).alias("mbp"),
            (10 + v / 20).alias("resp_rate"),
            F.when(i % 3 != 0, 90 + v / 100).alias("spo2"),
            (36 + v / 200).alias("temperature"),
        ),
        "chemistry": lambda: _of(ev, "view", "error", "signup").select(
            *episode,
            (130 + v / 50).alias("sodium"),
            (95 + v / 40).alias("chloride"),
            (3 + (i * 3 % 23) / 10).alias("potassium"),
            F.when(i % 7 != 0, 20 + v / 20).alias("bicarbonate"),
            (1 + v / 50).alias("creatinine"),
            (10 + v / 4).alias("bun"),
        ),
        "bg": lambda: _of(ev, "view", "error", "signup").select(
            *episode,
            (7 + (i * 5 % 11) / 20).alias("ph"),
            F.when(i % 18 != 0, (i * 7 % 50) / 5).alias("lactate"),
            (40 + v).alias("po2"),
            F.when(i % 27 != 0, (i % 16) / 20).alias("fio2"),
        ),
        "enzyme": lambda: _of(ev, "signup").select(*episode, v.alias("ast"), (v / 2).alias("alt")),
        "coagulation": lambda: _of(ev, "purchase").select(*episode, (1 + v / 100).alias("inr")),
        "complete_blood_count": lambda: _of(ev, "signup", "error").select(
            *episode, (v / 10).alias("wbc"), (8 + v / 50).alias("hemoglobin"), (100 + v).alias("platelet")
        ),
        "charlson": lambda: units(ev, customer).select("hadm_id", (F.col("subject_id") % 10).cast("int").alias("charlson_comorbidity_index")),
        "sofa": lambda: _of(ev, "error").select(
            "stay_id", ts.alias("endtime"), i, F.when(i % 9 != 0, i % 20).cast("int").alias("sofa_24hours")
        ),
        "urine_output": lambda: _of(ev, "purchase", "signup").select(*point, (10 * v).alias("urineoutput")),
    })


def study(spark: SparkSession, sf_dir: str, staged: bool = False, **params) -> Study:
    rules = Eligibility(excluded_codes=CODES, code_key="subject_id")
    return Study(tables(spark, sf_dir, staged), Params(rules=rules, **params), ("event_id",))


def relaxed_cohort(s: Study) -> DataFrame:
    """Every unit with a time zero, without the eligibility and index rules, as a stage."""
    full = s.tables["units"].join(s.tables["admissions"].select("hadm_id", "insurance"), "hadm_id", "left")
    return stage(time_zero(full, s.tables["kdigo_stages"]), "relaxed-cohort")
