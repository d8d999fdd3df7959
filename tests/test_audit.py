"""Failed conversions kept by step, column and reason."""

import re

import pytest
from pyspark.sql import functions as F

from checks import proxy
from skyledger.operators import cleaning
from skyledger.plans import qc
from skyledger.sources.audit import AuditStore
from skyledger.sources.tables import stage

KINDS = {"a b": "float", "7": "date", "c": "string"}
ROWS = [
    (1, "1.5", "2020-01-01", "x"), (2, "x1", "soon", None), (3, None, "soon", "y"),
    (4, "x2", None, "z"), (4, "x2", None, "z"), (None, "-", "2020-13-01", "nan"),
]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id long, `a b` string, `7` string, c string")
    cells = cleaning.failed_cells(df.select([F.col(f"`{c}`") for c in df.columns]), KINDS)
    kept = AuditStore(spark, str(tmp_path / "audit"))
    kept.write(df.withColumn("cells", cells), {"before": F.col("cells")}, ["id"])
    return df, kept


def test_report_is_that_of_the_table(store):
    df, kept = store
    want = cleaning.conversion_error_report(df, KINDS)
    got = kept.report("before")
    assert got.columns == want.columns and rows(got) == rows(want)
    assert kept.report("after").count() == 0
    some = kept.report("before", ["a b"], ["Invalid characters"])
    assert rows(some.select("detail", "row_count")) == [("Invalid: x", 3)]


def test_failed_rows_are_found_again_by_key(store):
    _, kept = store
    found = kept.failures("before", ["a b"], ["Invalid characters"], {"id": "long"})
    assert rows(found.select("id", "row_count")) == [(2, 1), (4, 2)]


def test_report_reads_the_folders_it_needs(store):
    _, kept = store
    plan = kept.report("before", ["a b"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*column_name.* = a b", plan)
    assert "ReadSchema: struct<detail:string,row_count:bigint>" in plan
    assert len(plan.split("FileScan")) == 2


def test_quality_control_with_a_store(spark, sf, tmp_path):
    raw = stage(proxy.raw_tickets(spark, sf), "raw")
    plain = qc.clean_tickets(raw)
    path = str(tmp_path / "audit")
    kept = qc.clean_tickets(raw, audit=path, audit_keys=["ITIN_ID"])
    for name in ("errors_before", "errors_after"):
        assert rows(kept.reports[name]) == rows(plain.reports[name])
        assert all(f"{path}/step" in f for f in kept.reports[name].inputFiles())
    assert kept.reports["errors_before"].count() and kept.reports["errors_before"].inputFiles()
    assert kept.cleaned.schema == plain.cleaned.schema
    assert kept.cleaned.exceptAll(plain.cleaned).count() == 0


def test_no_failures_and_names_that_clash(spark, tmp_path):
    df = spark.createDataFrame([(1, "1")], "detail long, a string")
    kept = AuditStore(spark, str(tmp_path / "audit"))
    with pytest.raises(ValueError):
        kept.write(df, {}, ["detail"])
    cells = cleaning.failed_cells(df, {"a": "float"})
    for table in (df, df.limit(0)):
        kept.write(table.withColumn("cells", cells), {"before": F.col("cells")})
        assert kept.report("before").count() == 0
