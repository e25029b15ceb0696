import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.compare import register, rows_of

SF = "/root/testdata/sf0.001"
NO_SQL = {"a8_file_checksums"}
# One query per family; the comparison tool runs all of them.
SAMPLE = [
    "a1_ingest_union_sources", "a6_json_sink", "a8_checksum_manifest_verify", "b3_cross_source_replicas",
    "b12_exclusive_exclusion_reason", "b13_overlapping_flag_counts", "b14_exclusive_reason_counts",
    "b17_duplicate_accounting", "c1_product_day_sales", "c6_cohort_top_n", "c9_grid_preflight",
    "c8_dense_daily_grid", "d1_product_rankings", "d2_monthly_trends", "e2_training_windows", "e6_forecast_window_variants",
    "e7_fallback_policy", "e10_window_backtest_frame", "e12_support_validation", "f8_all_pairs_smoothing", "f9_spike_threshold",
    "g4_history_context",
    "f6_pairwise_comparison", "f13_product_contributions", "f20_headline_summary", "f23_findings",
    "g5_long_series_union", "h1_credential_pattern_scan", "i1_sales_summary",
]
with_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")


def test_every_query_has_sql_unless_it_cannot():
    own = {name for name in contract.queries() if not name.startswith("op") and name != "pipeline"}
    assert own - set(contract.oracle_sql()) == NO_SQL
    assert set(contract.oracle_sql()) <= set(contract.queries())


@with_tables
@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    register(con, SF)
    df = contract.queries()[name](spark, SF)
    found = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, found.fetchall())


@with_tables
def test_entry(spark):
    assert contract.entry(spark).count() == 200
