"""Named queries: one per inventory item, no fixed input, a sample compared with SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import TABLES, normal

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["a0_profile_columns", "a9_class_balance", "a13_numeric_codes", "e4_apply_encoding", "l1_stratified_split", "l2_grouped_split",
          "m2_macro_scores", "m6_roc_auc_all", "m14_calibration_error", "d1_cut_sweep", "b1_group_bootstrap", "g1_auto_bars",
          "t4_ledger", "t6_diagnosis", "x7_redact_paths", "x10_claims", "x11_quality_stream", "f10_knn_vote"]


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() == 7


def test_names_and_twins():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(oracles) >= 100


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = entry_module.queries()[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    result = con.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(got, df.columns) == normal(result.fetchall(), columns)
