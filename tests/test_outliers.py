import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyledger.operators import outliers


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double")


def values(df, c="x"):
    return [r[c] for r in df.collect()]


def test_cap_mad(spark):
    df, report = outliers.cap_mad_report(frame(spark, [1.0, 2.0, 3.0, 4.0, 100.0, None]), ["x"])
    assert values(df) == [1.0, 2.0, 3.0, 4.0, 6.0, None]
    row = report.first()
    assert (row["median"], row["mad"], row["lower"], row["upper"]) == (3.0, 1.0, 0.0, 6.0)
    assert (row["capped_rows"], row["collapsed"]) == (1, False)
    assert row["capped_pct"] == pytest.approx(100 / 6)


def test_zero_mad_collapses_onto_the_median(spark):
    df, report = outliers.cap_mad_report(frame(spark, [5.0, 5.0, 5.0, 9.0]), ["x"])
    assert values(df) == [5.0] * 4
    assert report.first()["collapsed"] is True
    assert values(outliers.cap_mad(frame(spark, [2.0, 2.0]), ["x"])) == [2.0, 2.0]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.none() | st.floats(-1e5, 1e5), min_size=1, max_size=40))
def test_capped_values_lie_in_bounds(spark, data):
    df = frame(spark, data)
    bounds = outliers.mad_bounds(df, ["x"])
    capped = outliers.clip_columns(df, bounds)
    if bounds:
        b = bounds["x"]
        assert capped.where((F.col("x") < b.low) | (F.col("x") > b.high)).isEmpty()
    assert capped.where("x is null").count() == sum(v is None for v in data)


def test_iqr_flags_are_strict(spark):
    df = frame(spark, [1.0, 2.0, 3.0, 4.0, 100.0, None])
    flagged = outliers.outlier_flags(df, ["x"], "iqr")
    assert values(flagged, "x_is_outlier") == [False, False, False, False, True, False]


def test_zscore_flags(spark):
    df = frame(spark, [0.0] * 20 + [50.0, None])
    assert sum(values(outliers.outlier_flags(df, ["x"]), "x_is_outlier")) == 1
    constant = outliers.outlier_flags(frame(spark, [1.0, 1.0]), ["x"])
    assert values(constant, "x_is_outlier") == [False, False]


def test_summary(spark):
    row = outliers.outlier_summary(frame(spark, [1.0, 2.0, 3.0, 4.0, 10.0]), ["x"], "iqr").first()
    assert (row["skewness"], row["kurtosis"], row["outlier_count"]) == (1.14, -0.21, 1)
    constant = outliers.outlier_summary(frame(spark, [1.0, 1.0]), ["x"]).first()
    assert constant["skewness"] is None


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        outliers.outlier_flags(frame(spark, [1.0]), ["x"], "madness")
    with pytest.raises(ValueError):
        outliers.outlier_summary(frame(spark, [1.0]), ["x"], "madness")
