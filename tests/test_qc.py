"""The three quality pipelines, from CSV files written by the test."""

import pytest

from checks import proxy
from skyledger.operators.quality import columns_with_nulls
from skyledger.plans import qc
from skyledger.sources import tables


def from_csv(spark, df, kinds):
    path = tables.staging_path(spark, "qc_test")
    tables.write_table(df, path, "csv")
    return tables.read_raw_csv(spark, path, list(df.columns)).select(*kinds)


@pytest.mark.parametrize(
    "raw, kinds, clean, gone",
    [
        (proxy.raw_airports, qc.AIRPORT_KINDS, qc.clean_airports, ["CONTINENT"]),
        (proxy.raw_flights, qc.FLIGHT_KINDS, qc.clean_flights, []),
        (proxy.raw_tickets, qc.TICKET_KINDS, qc.clean_tickets, []),
    ],
)
def test_pipeline_invariants(spark, sf, raw, kinds, clean, gone):
    result = clean(from_csv(spark, raw(spark, sf), kinds))
    cleaned = result.cleaned.cache()
    assert result.dropped == gone
    assert cleaned.columns == [c for c in kinds if c not in gone]
    assert columns_with_nulls(cleaned) == []
    duplicates = result.reports["duplicates"].first()
    assert cleaned.count() <= duplicates["total_count"]
    report = {r["column_name"]: r for r in result.reports["capping"].collect()}
    assert list(report) == result.capped
    for c, r in report.items():
        assert cleaned.where(f"{c} < {r['lower']}D or {c} > {r['upper']}D").isEmpty()
    for name in ("errors_before", "errors_after", "nulls_before", "nulls_after", "outliers"):
        result.reports[name].collect()
    cleaned.unpersist()


def test_filters_and_repeats(spark, sf):
    result = qc.clean_flights(proxy.raw_flights(spark, sf))
    assert result.cleaned.select("CANCELLED").distinct().collect() == [(0.0,)]
    stats = result.reports["duplicates"].first()
    assert stats["duplicate_count"] > 0
    assert "DEP_DELAY" in result.capped and "ORIGIN_AIRPORT_ID" not in result.capped


def test_number_ids_are_capped_only_when_named(spark, sf):
    result = qc.clean_tickets(proxy.raw_tickets(spark, sf), number_ids=["ITIN_ID"], profile=True)
    assert "ITIN_ID" in result.capped
    assert result.reports["profile"].count() == len(qc.TICKET_KINDS)


def test_filter_column_with_gaps_is_imputed_unless_strict(spark, sf):
    from pyspark.sql import functions as F

    raw = proxy.raw_tickets(spark, sf)
    holes = raw.withColumn("ROUNDTRIP", F.when(F.col("PASSENGERS") != "1.0", F.col("ROUNDTRIP")))
    loose = qc.clean_tickets(holes).cleaned
    strict = qc.clean_tickets(holes, strict=True).cleaned
    assert loose.select("ROUNDTRIP").distinct().count() == 2
    assert strict.select("ROUNDTRIP").distinct().count() == 1
    assert loose.count() > strict.count()


def test_date_formats_can_be_named(spark, sf):
    raw = proxy.raw_flights(spark, sf).where("FL_DATE <> 'soon'")
    dated = raw.selectExpr("*", "date_format(FL_DATE, 'M/d/yyyy') as d").drop("FL_DATE").withColumnRenamed("d", "FL_DATE")
    cleaned = qc.clean_flights(dated, formats=["M/d/yyyy"]).cleaned
    assert dict(cleaned.dtypes)["FL_DATE"] == "timestamp"
    assert qc.clean_flights(dated).dropped == ["FL_DATE"]


def test_an_empty_table_keeps_its_columns(spark, sf):
    raw = proxy.raw_flights(spark, sf)
    result = qc.clean_flights(spark.createDataFrame([], raw.schema))
    assert result.cleaned.columns == raw.columns and result.cleaned.count() == 0
    assert (result.dropped, result.capped) == ([], [])
