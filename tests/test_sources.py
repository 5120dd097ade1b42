"""Scans, fallbacks, stages, exports and the whole study run."""

import pytest
from pyspark.sql import functions as F

from trialweave.plans import proxies
from trialweave.sources import (
    CASE_SCHEMA,
    TableSpec,
    export,
    load_stage,
    materialize,
    read_csv,
    read_input,
    resolve_source,
    save_stage,
    shared_dir,
    stage,
    write_csv,
)


def small(spark, n=5):
    return spark.range(n).select("id", (F.col("id") * 2).alias("v"))


def test_csv_needs_a_schema_and_a_matching_header(spark, tmp_path):
    path = str(tmp_path / "out")
    write_csv(small(spark), path, single_file=True)
    assert read_csv(spark, path, small(spark).schema).count() == 5
    with pytest.raises(ValueError):
        read_input(spark, TableSpec(path, format="csv"))
    with pytest.raises(Exception):
        read_csv(spark, path, small(spark).withColumnRenamed("v", "other").schema).collect()


def test_case_file_schema(spark, tmp_path):
    path = str(tmp_path / "cases")
    made = spark.range(3).select(*[F.lit(1).cast(f.dataType).alias(f.name) for f in CASE_SCHEMA.fields])
    write_csv(made, path)
    got = read_csv(spark, path, CASE_SCHEMA)
    assert len(got.columns) == 52 and got.filter("survive_die = 1").count() == 3


def test_source_choice_is_joint(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    small(spark, 3).write.parquet(one)
    small(spark, 7).write.parquet(two)
    missing = TableSpec(str(tmp_path / "none"))
    tables = {"a": TableSpec(two), "b": TableSpec(two)}
    files = {"a": [missing, TableSpec(one)], "b": [TableSpec(one)]}
    assert {k: d.count() for k, d in resolve_source(spark, files, tables).items()} == {"a": 3, "b": 3}
    # One input without a file sends all inputs to the tables.
    files["b"] = [missing]
    assert {k: d.count() for k, d in resolve_source(spark, files, tables).items()} == {"a": 7, "b": 7}
    with pytest.raises(FileNotFoundError):
        resolve_source(spark, {"a": [missing]}, {})


def test_stages(spark, tmp_path):
    assert stage(small(spark)).count() == 5
    first = save_stage(small(spark), str(tmp_path), "x")
    second = save_stage(load_stage(spark, first).withColumn("w", F.lit(1)), str(tmp_path), "x")
    assert first != second and load_stage(spark, second).columns == ["id", "v", "w"]
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_catalog_table_is_replaced_and_can_be_bucketed(spark):
    materialize(small(spark, 9), "stage_table")
    assert materialize(small(spark, 4), "stage_table", bucket_by=(2, ["id"])).count() == 4
    assert read_input(spark, TableSpec("stage_table", {"key": "id"})).columns == ["key"]
    spark.sql("DROP TABLE stage_table")


def test_export_is_ordered(spark, tmp_path):
    path = str(tmp_path / "sorted")
    export(small(spark, 50).orderBy(F.rand(1)), ["id"], path, "csv")
    assert read_csv(spark, path, small(spark).schema).count() == 50


def test_whole_study_runs(spark, tmp_path):
    """The strict funnel with rules loose enough for the proxy data, all stages in order."""
    from trialweave.operators.cohort import Eligibility
    from trialweave.plans.study import Params, Study

    rules = Eligibility(min_age=0, min_los_days=0, excluded_codes=proxies.CODES, code_key="subject_id")
    params = Params(
        rules=rules, window_h=48,
        denominator_terms=("strategy", "age", "vaso_flag_last1h"),
        ridge=1e-4,
    )
    tables = dict(proxies.tables(spark, "/root/testdata/sf0.1"))
    result = Study(tables, params, ("event_id",)).run(str(tmp_path))
    n = result.index.count()
    assert n > 10
    assert result.clones.count() == n * 48
    assert result.baseline.count() == result.subgroups.count() == result.outcomes.count() == n
    assert result.risk_difference().filter("time = 0").first()["rd"] == 0.0
    assert result.rmst().count() == 2
    assert result.cox().count() == 1
    assert "hr" in result.subgroup_cox(5).columns
    paths = result.reports()
    assert set(paths) == {"cox_results", "subgroup_cox", "weight_diagnostics", "risk_difference", "rmst", "merged_dataset"}
    assert spark.read.csv(paths["merged_dataset"], header=True).count() == n * 48
    assert "robust_se" in spark.read.csv(paths["cox_results"], header=True).columns


def test_narrowed_events_give_the_same_tables(spark):
    """Times that no window reaches are left out of the stages, and nothing else is lost."""
    full = proxies.study(spark, "/root/testdata/sf0.001")
    index = proxies.relaxed_cohort(full)
    middle = F.percentile_approx(F.unix_micros(F.col("t0_time").cast("timestamp")), 0.7)
    bound = index.agg(middle).first()[0]
    late = index.filter(F.unix_micros(F.col("t0_time").cast("timestamp")) >= bound)
    cohort = stage(late, "late")
    small = full.narrowed(cohort)
    assert small.tables["vitalsign"].count() < full.tables["vitalsign"].join(cohort, "stay_id", "left_semi").count()
    for make in (lambda s: s.baseline(cohort), lambda s: s.hour_panel(cohort), lambda s: s.outcomes(cohort)):
        assert sorted(map(str, make(small).collect())) == sorted(map(str, make(full).collect()))
    with pytest.raises(ValueError, match="narrowed"):
        small.hour_panel(cohort, 36)
