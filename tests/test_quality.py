import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyledger.operators import quality
from skyledger.operators.cleaning import (
    audit_conversions,
    clean_numeric_columns,
    conversion_error_report,
    fill_by_type,
    parse_date_parts,
    round_money,
)


@pytest.fixture
def gaps(spark):
    rows = [(1, "a", None, None), (2, None, None, 1.0), (None, "b", None, 2.0), (4, "b", None, 3.0)]
    return spark.createDataFrame(rows, "n int, t string, nothing string, d double")


def test_null_profile(gaps):
    rows = quality.null_profile(gaps).collect()
    assert [r["column_name"] for r in rows] == ["nothing", "d", "n", "t"]
    assert [r["null_pct"] for r in rows] == [100.0, 25.0, 25.0, 25.0]
    assert quality.columns_with_nulls(gaps) == ["n", "t", "nothing", "d"]


def test_null_profile_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert quality.null_profile(empty).isEmpty()
    assert quality.drop_all_null_columns(empty)[1] == ["a", "b"]
    assert quality.drop_high_null_columns(empty)[1] == []


def test_null_patterns(gaps):
    found = {r["pattern"]: r["row_count"] for r in quality.null_patterns(gaps).collect()}
    assert found == {"0011": 1, "0110": 1, "1010": 1, "0010": 1}


def test_drop_columns(gaps):
    kept, dropped = quality.drop_all_null_columns(gaps)
    assert (kept.columns, dropped) == (["n", "t", "d"], ["nothing"])
    assert quality.drop_high_null_columns(gaps, 25)[1] == ["nothing"]
    assert quality.drop_high_null_columns(gaps, 24.9)[1] == ["n", "t", "nothing", "d"]


def test_classify(spark):
    df = spark.range(100).selectExpr(
        "id as wide", "id % 20 as narrow", "id % 21 as edge", "cast(id as string) as text",
        "id > 5 as flag", "id % 3 as size",
    )
    kinds = quality.classify_columns(df, ordinal=["size"])
    assert kinds.numerical == ["wide", "edge"]
    assert kinds.categorical == ["narrow", "text", "flag"]
    assert kinds.ordinal == ["size"]
    gaps, again = quality.nulls_and_kinds(df)
    assert (gaps, again.numerical) == ([], ["wide", "edge"])


def test_duplicates(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,), (None,)], "x int")
    row = quality.duplicate_stats(df).first()
    assert (row["total_count"], row["duplicate_count"]) == (6, 5)
    small = df.where("x is not null")
    kept, stats = quality.check_duplicates(small)
    assert sorted(r[0] for r in kept.collect()) == [1, 2]
    assert (stats.first()["duplicate_count"], stats.first()["duplicate_pct"]) == (3, 75.0)
    assert quality.check_duplicates(small, auto_drop=False)[0].count() == 4
    assert quality.duplicate_stats(df.where("x > 9")).first()["duplicate_pct"] is None


def test_drop_duplicates_keeps_the_first(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), (None, 5), (None, 4)], "k string, v int")
    kept = quality.drop_duplicates(df, ["k"], ["v"])
    assert sorted((r["k"] or "", r["v"]) for r in kept.collect()) == [("", 4), ("a", 1), ("b", 3)]
    with pytest.raises(ValueError):
        quality.drop_duplicates(df, ["k"])


def test_impute(spark):
    rows = [(1.0, "b", 1), (None, "a", None), (2.0, "b", 1), (10.0, "a", 2), (None, None, 2)]
    df = spark.createDataFrame(rows, "x double, t string, n int")
    median = quality.impute(df, ["x"], ["t", "n"]).collect()
    assert [r["x"] for r in median] == [1.0, 2.0, 2.0, 10.0, 2.0]
    assert [r["t"] for r in median] == ["b", "a", "b", "a", "a"]  # the smaller of two modes
    assert [r["n"] for r in median] == [1, 1, 1, 2, 2]
    mean = quality.impute(df, ["x"], ["t", "n"], "mean", "constant", "Unknown")
    assert mean.collect()[1]["x"] == pytest.approx(13 / 3)
    assert [r["n"] for r in mean.collect()] == ["1", "Unknown", "1", "2", "2"]
    kept = quality.impute(df, [], ["n"], "mean", "constant", "Unknown", numeric_mode="keep")
    assert dict(kept.dtypes)["n"] == "int"
    assert quality.impute(df, [], []) is df


def test_mode_of_numbers_breaks_ties_by_value(spark):
    df = spark.createDataFrame([(9,), (10,), (9,), (10,), (None,)], "n int")
    assert quality.impute(df, [], ["n"]).collect()[-1]["n"] == 9


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.none() | st.floats(-9, 9), st.none() | st.sampled_from("abc")), min_size=1, max_size=30))
def test_impute_leaves_no_nulls(spark, rows):
    df = spark.createDataFrame(rows, "x double, t string")
    full = quality.impute(df, ["x"], ["t"])
    known = [any(r[i] is not None for r in rows) for i in (0, 1)]
    for c, any_known in zip("xt", known):
        assert full.where(f"{c} is null").isEmpty() is any_known or not any_known


def test_filter_skips_columns_with_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), (None, 1.0)], "t string, x double")
    allowed = {"t": ["a"], "x": [1.0]}
    loose = quality.filter_allowed(df, allowed, ["t", "x"])
    assert (loose.rows.count(), loose.categorical, loose.numerical) == (3, ["t"], ["x"])
    strict = quality.filter_allowed(df, allowed, ["t", "x"], strict=True)
    assert (strict.rows.count(), strict.categorical, strict.numerical) == (1, [], [])


def test_column_profile(gaps):
    rows = {r["column_name"]: r for r in quality.column_profile(gaps).collect()}
    assert (rows["d"]["mean"], rows["d"]["p50"], rows["d"]["distinct_count"]) == (2.0, 2.0, 3)
    assert (rows["t"]["top_value"], rows["t"]["top_count"], rows["t"]["mean"]) == ("b", 2, None)
    assert rows["nothing"]["distinct_count"] == 0 and rows["nothing"]["null_count"] == 4
    rough = {r["column_name"]: r for r in quality.column_profile(gaps, exact=False).collect()}
    assert (rough["d"]["p50"], rough["t"]["distinct_count"]) == (2.0, 2)


def test_audit_and_report(spark):
    rows = [("1", "2019-01-01"), ("x" * 90, "soon"), (None, None), ("1.2.3", "2019-13-01")]
    df = spark.createDataFrame(rows, "n string, d string")
    audited = audit_conversions(df, {"n": "float", "d": "date"}).collect()
    assert [r["n_conversion_success"] for r in audited] == [True, False, False, False]
    assert [r["d_conversion_success"] for r in audited] == [True, False, False, False]
    report = conversion_error_report(df, {"n": "float", "d": "date"}).collect()
    found = {(r["column_name"], r["error_type"]): r["printed_detail"] for r in report}
    assert found["n", "Invalid characters"] == "Invalid: " + "x" * 68 + "..."
    assert found["d", "Invalid characters"] == "Invalid: soon"
    assert found["d", "Format error"] == "Invalid: 2019-13-01"
    assert found["n", "Original value was NaN"] == ""
    with pytest.raises(ValueError):
        audit_conversions(df, {"n": "complex"})


def test_string_audit_takes_nan_for_missing(spark):
    df = spark.createDataFrame([("nan",), ("a",)], "t string")
    assert [r["t_converted"] for r in audit_conversions(df, {"t": "string"}).collect()] == [None, "a"]


def test_fill_by_type(spark):
    df = spark.createDataFrame([(None, None, None)], "x double, t string, d timestamp")
    row = fill_by_type(fill_by_type(fill_by_type(df, "x", "float"), "t", "string"), "d", "date")
    assert row.selectExpr("x", "t", "cast(d as string)").first() == (0.0, "Unknown", "1970-01-01 00:00:00")
    assert fill_by_type(df, "x", "int") is df


def test_date_parts_rounding_and_numbers(spark):
    df = spark.createDataFrame([("2019-03-02", "Two", 0.125), ("?", "3.5", None)], "FL_DATE string, n string, m double")
    dated = parse_date_parts(df).select("YEAR", "MONTH").collect()
    assert dated == [(2019, 3), (None, None)]
    assert [r["m"] for r in round_money(df).collect()] == [0.12, None]
    assert [r["n"] for r in clean_numeric_columns(df, ["n", "m"]).collect()] == [2.0, 3.5]


def test_rows_of_the_summaries_are_drawn_once(spark):
    df = spark.range(4000).selectExpr("id % 97 / 4.0 as a", "cast(id as double) as b", "string(id) as t")
    measures = quality.kind_measures(df)
    assert not any("xxhash64" in str(m) for m in measures)  # not again for each column
    facts, kinds = quality.facts_and_kinds(df)
    assert kinds.numerical == ["a", "b"] and facts.rows == 4000
    drawn = df.where(quality.some_rows(df))
    assert 0 < drawn.count() < 1000
    points = [i / 64 for i in range(65)]
    expected = drawn.agg(F.percentile_approx("b", points, 1000)).first()[0]
    assert facts.extents["b"].depth == tuple(expected)
