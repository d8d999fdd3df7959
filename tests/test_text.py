import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyledger.functions import text
from tests.conftest import results

X = F.col("x")


def test_clean_numeric_edges(column):
    cases = {
        "Thirty Five": 35.0, "THIRTY  five": 35.0, "12": 12.0, "12.5": 12.5, "-5.0": -5.0,
        "-5": None, " 12": None, "8.9abc": None, "Two Hundred": 102.0, "12 Five": 5.0,
        "thirteen": None, "Thirty-Five": None, "": None, None: None, "1e3": None, "1,200": None,
        "12d": None, "Zero": 0.0,
    }
    assert results(column(cases), text.clean_numeric(X)) == list(cases.values())


def test_clean_numeric_signed(column):
    df = column(["-5", "5", "-5.5", "--5", "minus"])
    assert results(df, text.clean_numeric(X, "signed")) == [-5.0, 5.0, -5.5, None, None]
    with pytest.raises(ValueError):
        text.clean_numeric(X, "loose")


def test_word_number_knows_21_words(column):
    assert len(text.NUMBER_WORDS) == 21
    df = column(["eleven", "TEN", "thousand", None])
    assert results(df, text.word_number(X)) == [None, 10.0, 1000.0, None]


def test_parse_number(column):
    cases = {
        "1e3": 1000.0, " 7 ": 7.0, "+2.": 2.0, ".5": 0.5, "12d": None, "abc": None, "": None,
        None: None, "1.2.3": None, "inf": float("inf"),
    }
    assert results(column(cases), text.parse_number(X)) == list(cases.values())


def test_conversion_error(column):
    cases = {
        None: ("Original value was NaN", ""),
        "8.9abc": ("Invalid characters", "Invalid: abc"),
        "1.2.3": ("Format error", "Invalid: 1.2.3"),
        "7.5": ("No error", ""),
        "-": ("Format error", "Invalid: -"),
    }
    error = text.conversion_error(X, text.parse_number(X))
    found = results(column(cases), error["error_type"], error["detail"])
    assert found == list(cases.values())


def test_conversion_error_of_a_non_text(column):
    error = text.conversion_error(X, F.lit(None), raw_is_text=False)
    found = results(column([3], "int"), error["error_type"], error["detail"])
    assert found == [("Other conversion error", "3")]


def test_shorten(column):
    texts = ["a" * 80, "b" * 81]
    assert results(column(texts), text.shorten(X)) == ["a" * 80, "b" * 77 + "..."]


def test_standardize_date(column):
    cases = {
        "3/2/19": "2019-03-02", "03/02/69": "1969-03-02", "03/02/68": "2068-03-02",
        "3/2/2019": None, "2019-03-02": "2019-03-02", "13/1/19": None, "2/30/19": None,
        "soon": "soon", None: None, "2/29/20": "2020-02-29",
    }
    assert results(column(cases), text.standardize_date(X)) == list(cases.values())


def test_parse_timestamp_formats(column):
    cases = {
        "2019-03-02": "2019-03-02 00:00:00", "2019-03-02 10:11:12": "2019-03-02 10:11:12",
        "2019-03-02T10:11:12": "2019-03-02 10:11:12", "2019-02-30": None, "3/2/19": None, None: None,
    }
    assert results(column(cases), text.parse_timestamp(X).cast("string")) == list(cases.values())
    named = text.parse_timestamp(X, ["d MMM yyyy", "M/d/yyyy"]).cast("string")
    assert results(column(["2 Mar 2019", "3/2/2019", "x"]), named) == [
        "2019-03-02 00:00:00", "2019-03-02 00:00:00", None,
    ]


def test_symmetric_key(spark):
    rows = [("JFK", "ATL"), ("ATL", "JFK"), ("JFK", None), (None, "JFK"), ("A", "A")]
    df = spark.createDataFrame(rows, "a string, b string")
    found = [r[0] for r in df.select(text.symmetric_key(F.col("a"), F.col("b"))).collect()]
    assert found == ["ATL-JFK", "ATL-JFK", None, None, "A-A"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text("ABCXYZ", min_size=1, max_size=3), st.text("ABCXYZ", min_size=1, max_size=3)), min_size=1, max_size=20))
def test_symmetric_key_ignores_direction(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    there, back = text.symmetric_key(F.col("a"), F.col("b")), text.symmetric_key(F.col("b"), F.col("a"))
    assert df.where(~there.eqNullSafe(back)).isEmpty()


def test_route_end(column):
    df = column(["ATL-JFK", "ATL", "", "atl-jfk", None])
    assert results(df, text.route_end(X, "A")) == ["ATL", "ATL", None, "atl", None]
    assert results(df, text.route_end(X, "B")) == ["JFK", None, None, "jfk", None]
    assert results(df, text.route_end(X, "B", strict=True)) == ["JFK", None, None, None, None]
    with pytest.raises(ValueError):
        text.route_end(X, "C")


def test_coordinates(column):
    df = column(["-73.78, 40.64", "east, 1", "5", None])
    assert results(df, text.longitude(X)) == [-73.78, None, 5.0, None]
    assert results(df, text.latitude(X)) == [40.64, 1.0, None, None]
