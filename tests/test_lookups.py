"""Boundary rows of the as-of, interval and slice lookups."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trialweave.functions.exprs import rate_per_weight
from trialweave.operators import joins, lookups

T0 = datetime(2024, 1, 1, 12)
H = timedelta(hours=1)


def units(spark, *ids):
    return spark.createDataFrame([(i, T0) for i in ids], "stay_id long, t0_time timestamp_ntz")


def points(spark, rows):
    return spark.createDataFrame(rows, "stay_id long, charttime timestamp_ntz, v double, id long")


def spans(spark, rows):
    return spark.createDataFrame(rows, "stay_id long, starttime timestamp_ntz, endtime timestamp_ntz, v double, id long")


def at_t0(spark, lookup, *ids):
    rows = lookups.gather(units(spark, *ids), "stay_id", "t0_time", [lookup]).collect()
    return {r["stay_id"]: r for r in rows}


def test_point_window_bounds(spark):
    ev = points(spark, [(1, T0 - 6 * H, 1.0, 1), (2, T0, 2.0, 2), (3, T0 + timedelta(microseconds=1), 3.0, 3)])
    got = at_t0(spark, lookups.last(ev, "stay_id", "charttime", "v", 6, tiebreak=("id",)), 1, 2, 3, 4)
    assert {k: r["v"] for k, r in got.items()} == {1: None, 2: 2.0, 3: None, 4: None}


def test_whole_row_keeps_null_and_value_lookup_skips_it(spark):
    ev = points(spark, [(1, T0 - 2 * H, 5.0, 1), (1, T0 - H, None, 2)])
    whole = lookups.last(ev, "stay_id", "charttime", {"whole": "v"}, 6, tiebreak=("id",))
    value = lookups.last(ev, "stay_id", "charttime", {"value": "v"}, 6, not_null="v", tiebreak=("id",))
    row = lookups.gather(units(spark, 1), "stay_id", "t0_time", [whole, value]).first()
    assert (row["whole"], row["value"]) == (None, 5.0)


def test_equal_times_use_the_larger_id(spark):
    ev = points(spark, [(1, T0 - H, 5.0, 7), (1, T0 - H, 9.0, 3)])
    got = at_t0(spark, lookups.last(ev, "stay_id", "charttime", "v", 6, tiebreak=("id",)), 1)
    assert got[1]["v"] == 5.0


def test_interval_bounds_are_strict_and_open_end_counts(spark):
    iv = spans(
        spark,
        [
            (1, T0 - 9 * H, T0 - 6 * H, 1.0, 1),
            (2, T0, T0 + H, 1.0, 2),
            (3, T0 - 20 * H, None, 1.0, 3),
            (4, T0 - 9 * H, T0 - 6 * H + timedelta(microseconds=1), 1.0, 4),
        ],
    )
    got = at_t0(spark, lookups.overlaps(iv, "stay_id", "starttime", "endtime", "hit", 6), 1, 2, 3, 4, 5)
    assert {k: r["hit"] for k, r in got.items()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 0}


def test_open_interval_is_newest(spark):
    iv = spans(spark, [(1, T0 - 3 * H, T0 + 9 * H, 1.0, 1), (1, T0 - 20 * H, None, 2.0, 2)])
    pick = lambda first: at_t0(
        spark, lookups.overlap_last(iv, "stay_id", "starttime", "endtime", "v", 6, open_first=first), 1
    )[1]["v"]
    assert pick(True) == 2.0
    assert pick(False) == 1.0


def test_valid_at_has_closed_ends_and_latest_start_wins(spark):
    iv = spans(
        spark,
        [
            (1, T0, T0 + H, 1.0, 1), (2, T0 - H, T0, 2.0, 2), (3, T0 - 5 * H, None, 3.0, 3), (3, T0 - H, T0 + H, 4.0, 4),
            (4, T0 - 5 * H, T0 - H, 5.0, 5),
        ],
    )
    got = at_t0(spark, lookups.valid_at(iv, "stay_id", "starttime", "endtime", "v"), 1, 2, 3, 4)
    assert {k: r["v"] for k, r in got.items()} == {1: 1.0, 2: 2.0, 3: 4.0, 4: None}


def test_empty_window_sum(spark):
    ev = points(spark, [(1, T0 - H, 3.0, 1), (1, T0 - 2 * H, 4.0, 2)])
    zero = lookups.window_value(ev, "stay_id", "charttime", "v", "zero", "sum", 6, empty=0.0)
    null = lookups.window_value(ev, "stay_id", "charttime", "v", "null", "sum", 6)
    rows = lookups.gather(units(spark, 1, 2), "stay_id", "t0_time", [zero, null]).orderBy("stay_id").collect()
    assert [(r["zero"], r["null"]) for r in rows] == [(7.0, 7.0), (0.0, None)]


def test_first_time_includes_t0(spark):
    ev = points(spark, [(1, T0, 1.0, 1), (1, T0 - H, 1.0, 2), (2, T0 + 3 * H, 1.0, 3), (2, T0 + 2 * H, 1.0, 4)])
    got = at_t0(spark, lookups.first_time(ev, "stay_id", "charttime", "start"), 1, 2, 3)
    assert {k: r["start"] for k, r in got.items()} == {1: T0, 2: T0 + 2 * H, 3: None}


def test_event_semi_and_anti_joins(spark):
    ev = points(spark, [(1, T0, 1.0, 1), (2, T0 - H, 1.0, 2), (2, T0 + H, 1.0, 3), (3, T0 + H, 1.0, 4)])
    u = units(spark, 1, 2, 3, 4)
    has = {r["stay_id"] for r in joins.has_event(u, ev, "stay_id", "charttime", "t0_time").collect()}
    clear = {r["stay_id"] for r in joins.no_event_before(u, ev, "stay_id", "charttime", "t0_time").collect()}
    assert has == {1, 2}
    assert clear == {1, 3, 4}


def test_rate_needs_a_positive_weight(spark):
    df = spark.createDataFrame([(12.0, 2.0), (12.0, 0.0), (12.0, None), (12.0, -1.0)], "total double, w double")
    assert [r[0] for r in df.select(rate_per_weight("total", "w", 6)).collect()] == [1.0, None, None, None]


def naive_slices(spark, u, ev, w, n, agg):
    grid = lookups.hour_grid(u, "t0_time", n)
    lo = F.col("t_end") - F.expr(f"INTERVAL {w} HOUR")
    e = ev.withColumnRenamed("stay_id", "k")
    cond = (F.col("stay_id") == F.col("k")) & (F.col("charttime") > lo) & (F.col("charttime") <= F.col("t_end"))
    rows = grid.join(e, cond, "left").groupBy("stay_id", "hour_index").agg(agg.alias("x")).collect()
    return {(r["stay_id"], r["hour_index"]): r["x"] for r in rows}


@pytest.mark.parametrize("w", [1, 6])
def test_slices_equal_a_naive_range_join(spark, w):
    import random

    rng = random.Random(3)
    rows = [
        (rng.randrange(1, 5), T0 + timedelta(seconds=rng.randrange(-30000, 60000)), float(rng.randrange(100)), i)
        for i in range(400)
    ] + [(1, T0 + h * H, 1.0, 1000 + h) for h in range(-7, 14)]
    ev, u = points(spark, rows), units(spark, 1, 2, 3, 4, 5)
    total = lookups.window_value(ev, "stay_id", "charttime", "v", "x", "sum", w)
    newest = lookups.last(ev, "stay_id", "charttime", {"y": "id"}, w, tiebreak=("id",))
    got = lookups.gather_slices(u, "stay_id", "t0_time", 12, [total, newest]).collect()
    assert {(r["stay_id"], r["hour_index"]): r["x"] for r in got} == naive_slices(spark, u, ev, w, 12, F.sum("v"))
    best = F.max_by("id", F.struct("charttime", "id"))
    assert {(r["stay_id"], r["hour_index"]): r["y"] for r in got} == naive_slices(spark, u, ev, w, 12, best)


@pytest.mark.parametrize("w", [1, 4])
def test_interval_slices_equal_a_naive_range_join(spark, w):
    import random

    rng = random.Random(5)
    rows = []
    for i in range(120):
        start = T0 + timedelta(seconds=rng.randrange(-40000, 60000))
        end = None if i % 9 == 0 else start + timedelta(seconds=rng.choice([0, 3600, rng.randrange(20000)]))
        rows.append((rng.randrange(1, 40), start, end, float(rng.randrange(50)), i))
    rows += [(40, T0 - H, T0 + h * H, 1.0, 500 + h) for h in range(-3, 5)]
    iv, u = spans(spark, rows), units(spark, *range(1, 42))
    look = lookups.overlap_value(iv, "stay_id", "starttime", "endtime", "v", "x", w)
    got = lookups.gather_slices(u, "stay_id", "t0_time", 12, [look]).collect()
    grid = lookups.hour_grid(u, "t0_time", 12)
    lo = F.col("t_end") - F.expr(f"INTERVAL {w} HOUR")
    e = iv.withColumnRenamed("stay_id", "k")
    cond = (F.col("stay_id") == F.col("k")) & (F.col("starttime") < F.col("t_end")) & (
        F.coalesce("endtime", "t_end") > lo
    )
    want = grid.join(e, cond, "left").groupBy("stay_id", "hour_index").agg(F.max("v").alias("x")).collect()
    assert {(r[0], r[1]): r["x"] for r in want} == {(r["stay_id"], r["hour_index"]): r["x"] for r in got}


def test_hot_unit_is_split_and_complete(spark):
    """A unit with most of the rows: its partition of the join is split as measured, no unit is repeated beforehand."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "false",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        n = 30_000
        ev = spark.range(n).select(
            F.when(F.col("id") % 3 > 0, 1).otherwise(2 + F.col("id") % 50).cast("long").alias("stay_id"),
            (F.lit(T0) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") % 20000).cast("decimal(18,6)")))
            .cast("timestamp_ntz").alias("charttime"),
            F.lit(1.0).alias("v"),
        )
        u = units(spark, *range(1, 53))
        out = lookups.gather(
            u, "stay_id", "t0_time", [lookups.window_value(ev, "stay_id", "charttime", "v", "n", "sum", 6)]
        )
        got = {r["stay_id"]: r["n"] for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan and "Generate" not in plan
        assert got[1] == 20_000.0
        assert sum(v for v in got.values() if v) == float(n)
        hours = lookups.gather_slices(
            u, "stay_id", "t0_time", 6, [lookups.window_value(ev, "stay_id", "charttime", "v", "n", "sum", 6)]
        )
        counted = {(r["stay_id"], r["hour_index"]): r["n"] for r in hours.collect()}
        assert "skew=true" in hours._jdf.queryExecution().executedPlan().toString()
        assert counted == naive_slices(spark, u, ev, 6, 6, F.sum("v"))
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_event_scans_are_bounded_by_the_cohort(spark, tmp_path):
    """The span of the units' times is pushed into every event scan and changes no result."""
    import random

    rng = random.Random(11)
    at = {i: T0 + i * H for i in range(8)}
    u = spark.createDataFrame([*at.items(), (8, None)], "stay_id long, t0_time timestamp_ntz")
    rows, ranges = [], []
    for i in range(600):
        start = T0 + timedelta(minutes=rng.randrange(-3000, 3000))
        rows.append((rng.randrange(10), start, float(i), i))
        ranges.append((rng.randrange(10), start, None if i % 5 == 0 else start + rng.randrange(9) * H, float(i), i))
    points(spark, rows).write.parquet(f"{tmp_path}/points")
    spans(spark, ranges).write.parquet(f"{tmp_path}/spans")
    ev, iv = spark.read.parquet(f"{tmp_path}/points"), spark.read.parquet(f"{tmp_path}/spans")
    ties = ("id",)
    lower = F.col("t0_time") - F.expr("INTERVAL 20 HOUR")
    found = [
        lookups.last(ev, "stay_id", "charttime", {"a": "v"}, 6, tiebreak=ties),
        lookups.last(ev, "stay_id", "charttime", {"b": "v"}, None, tiebreak=ties),
        lookups.last_ahead(ev, "stay_id", "charttime", {"c": "v"}, 9, tiebreak=ties),
        lookups.first_time(ev, "stay_id", "charttime", "d"),
        lookups.window_value(ev, "stay_id", "charttime", "v", "e", "min", lower=lower),
        lookups.overlaps(iv, "stay_id", "starttime", "endtime", "f", 3),
        lookups.overlap_last(iv, "stay_id", "starttime", "endtime", {"g": "v"}, 5, tiebreak=ties),
        lookups.valid_at(iv, "stay_id", "starttime", "endtime", {"h": "v"}, tiebreak=ties),
    ]
    span = lookups.time_span(u, "t0_time")
    bounded = lookups.gather(u, "stay_id", "t0_time", found, span)
    got = sorted(bounded.collect())
    assert got == sorted(lookups.gather(u, "stay_id", "t0_time", found).collect())
    assert len(got) == 9 and all(any(r[c] is not None for r in got) for c in "abcdefgh")
    plan = bounded._jdf.queryExecution().executedPlan().toString()
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
    assert pushed and all("2024-01-01" in line or "2024-01-02" in line for line in pushed)
    sliced = [
        lookups.window_value(ev, "stay_id", "charttime", "v", "x", "sum", 2),
        lookups.overlap_value(iv, "stay_id", "starttime", "endtime", "v", "y", 4),
    ]
    hours = [
        sorted(lookups.gather_slices(u, "stay_id", "t0_time", 12, sliced, span=b).collect(), key=lambda r: (r[0], r[2]))
        for b in (span, None)
    ]
    assert hours[0] == hours[1] and len(hours[0]) == 9 * 12
    assert all(r["x"] is None and r["y"] is None for r in hours[0] if r["t0_time"] is None)


def test_keys_of_different_width_meet(spark):
    ev = points(spark, [(1, T0, 3.0, 1)]).withColumn("stay_id", F.col("stay_id").cast("int"))
    look = lookups.last(ev, "stay_id", "charttime", "v", 6, tiebreak=("id",))
    assert at_t0(spark, look, 1)[1]["v"] == 3.0
    text = lookups.last(ev.withColumn("stay_id", F.col("stay_id").cast("string")), "stay_id", "charttime", "v", 6)
    with pytest.raises(TypeError, match="stay_id"):
        lookups.gather(units(spark, 1), "stay_id", "t0_time", [text])


def test_events_without_time_count_nowhere(spark):
    """An unknown time or interval start lies in no window and in no hour slice."""


    t0 = datetime(2024, 1, 1)
    units = spark.createDataFrame([(1, t0)], "u int, t0 timestamp_ntz")
    events = spark.createDataFrame([(1, None, 5.0), (1, t0 + timedelta(minutes=30), 1.0)], "u int, t timestamp_ntz, v double")
    spans = spark.createDataFrame([(1, None, t0 + timedelta(hours=2)), (1, None, None)], "u int, a timestamp_ntz, b timestamp_ntz")
    found = [
        lookups.window_value(events, "u", "t", "v", "total", window=1, empty=0.0),
        lookups.overlaps(spans, "u", "a", "b", "on", 1),
    ]
    rows = lookups.gather_slices(units, "u", "t0", 3, found).orderBy("hour_index").collect()
    assert [(r.total, r.on) for r in rows] == [(1.0, 0), (0.0, 0), (0.0, 0)]
    later = units.selectExpr("u", "t0 + INTERVAL 1 HOUR AS t0")
    assert [(r.total, r.on) for r in lookups.gather(later, "u", "t0", found).collect()] == [(1.0, 0)]
    twice = units.unionAll(units)
    with pytest.raises(Exception, match="more than once"):
        lookups.gather(twice, "u", "t0", found).collect()


def test_slices_are_dealt_before_they_are_repeated(spark, monkeypatch):
    monkeypatch.setattr(lookups, "GRID_ROWS", 16)
    ev = points(spark, [(k, T0 - H / 2 + h * H, 1.0, 10 * k + h) for k in (1, 2, 3) for h in range(3)])
    total = lookups.window_value(ev, "stay_id", "charttime", "v", "x", "sum", 6)
    hours = lookups.gather_slices(units(spark, 1, 2, 3, 4), "stay_id", "t0_time", 12, [total])
    plan = hours._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(stay_id" in plan and "hour_index" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    # 48 rows of the grid, 16 to a task
    assert ", 3), REPARTITION_BY_NUM" in plan
    got = {(r["stay_id"], r["hour_index"]): r["x"] for r in hours.collect()}
    assert len(got) == 48 and got[1, 0] == 2.0 and got[3, 2] == 3.0 and got[4, 5] is None
