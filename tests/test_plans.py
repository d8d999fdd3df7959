"""What the physical plans must look like."""

import re
from pathlib import Path

import pytest

from checks import proxy
from checks.queries import QUERIES, kpi_table
from skyledger.operators import quality
from skyledger.plans import answers, explore
from skyledger.sources import tables

ROOT = Path(__file__).resolve().parent.parent


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_in_any_plan(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert not re.search(r"Python|Pandas|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_top_k_keeps_only_k_rows_per_task(spark, sf):
    assert "TakeOrderedAndProject" in plan(answers.recommended(kpi_table(spark, sf)))


def test_best_per_group_prunes_before_the_shuffle(spark, sf):
    text = plan(explore.distance_and_cost(kpi_table(spark, sf)))
    assert re.search(r"WindowGroupLimit.*Final[\s\S]*Exchange[\s\S]*WindowGroupLimit.*Partial", text)
    kept = quality.drop_duplicates(proxy.flights(spark, sf), ["ORIGIN"], ["FL_DATE"])
    assert "Partial" in plan(kept)


def test_airports_are_broadcast_only_while_small(spark, sf):
    small = plan(kpi_table(spark, sf))
    assert small.count("BroadcastHashJoin") >= 2
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(kpi_table(spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_aggregates_combine_before_the_shuffle(spark, sf):
    text = plan(kpi_table(spark, sf))
    assert text.count("partial_avg") >= 3


def test_only_needed_columns_are_read(spark, sf):
    path, columns = f"{sf}/lineitem.parquet", ["l_quantity"]
    text = plan(tables.read_clean(spark, path, columns).where("l_quantity > 3"))
    assert "ReadSchema: struct<l_quantity:double>" in text
    text = plan(tables.read_clean(spark, path, columns, nan_as_null=False).where("l_quantity > 3"))
    assert "ReadSchema: struct<l_quantity:double>" in text
    assert "GreaterThan(l_quantity,3.0)" in text


def test_library_has_no_python_functions_on_rows():
    for path in (ROOT / "skyledger").rglob("*.py"):
        if path.is_relative_to(ROOT / "skyledger" / "llm"):
            continue
        code = path.read_text()
        assert not re.search(r"udf|applyIn|mapIn|\.rdd\b|toPandas|localCheckpoint|crossJoin", code), path
