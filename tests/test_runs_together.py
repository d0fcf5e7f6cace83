"""Attempts are dealt by run once; what follows inside a run moves no row again."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import normal
from plumbline.catalog import batch
from plumbline.operators import trials as T

SMALLEST = "/root/testdata/sf0.001"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{SMALLEST}/lineitem.parquet'")
    df = entry_module.queries()[name](spark, SMALLEST)
    result = con.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    got = normal([tuple(r) for r in df.collect()], df.columns)
    assert got and got == normal(result.fetchall(), columns)


def test_novelty_moves_each_side_once(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffles(entry_module.queries()["t8_novelty"](spark, SMALLEST)) <= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    against_sql(spark, "t8_novelty")


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "TASK_ROWS", 50)
    rows = spark.range(5000).withColumnRenamed("id", "run")
    assert T.by_run(rows).rdd.getNumPartitions() == 100


def test_a_plan_without_history_or_with_a_null_in_it_is_new(spark):
    schema = "run string, model string, params map<string,string>, pipeline string, tuned boolean"
    plans = spark.createDataFrame([("a", "logreg", {"x": "1"}, "p", False), ("b", "logreg", None, "p", False), ("c", "logreg", {"x": "1"}, "p", False)], schema)
    history = spark.createDataFrame([("b", "logreg", None, "p", False), ("c", "logreg", {"x": "1"}, "p", False), ("c", "logreg", {"x": "1"}, "p", False)], schema)
    told = {r["run"]: (r["repeated"], r["next_model"]) for r in T.novelty(plans, history).collect()}
    assert told["a"] == told["b"] == (False, "logreg")
    assert told["c"][0] and told["c"][1] != "logreg"


@pytest.mark.parametrize("name", ["s8_run_registry", "s9_attempts"])
def test_histories_are_built_by_one_shuffle(spark, name):
    assert shuffles(batch._nested(spark, SMALLEST)) == 1
    against_sql(spark, name)


def test_histories_are_written_compact(spark):
    found = batch._histories(spark, SMALLEST)
    path = spark._jvm.org.apache.hadoop.fs.Path(found.inputFiles()[0].rsplit("/", 1)[0])
    written = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    assert written < 100 * found.selectExpr("sum(size(history))").first()[0]
