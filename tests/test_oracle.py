"""Registered queries against their SQL at the smallest scale.

A spread of queries by default; set ALL_QUERIES=1 for every one.
"""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
SPREAD = (
    "scan_project csv_round_trip source_fallback code_match first_row_per_key quantiles_exact ecdf_rank risk_set_sums "
    "has_event_before asof_last_6h overlap_last_open_first window_sum_zero grid_last grid_overlap eligible attrition "
    "baseline subgroup_flags hour_panel_12 clone_censor outcomes weights_truncated km_weighted rmst cox_weighted "
    "weight_hist weight_density outcome_hazard"
).split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SPREAD


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["hour_index", "strategy", "censor_rate", "n"] and df.count() == 48
