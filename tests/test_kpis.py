import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyledger.functions.money import airport_fee, excess_delay_cost, ratio, round_half_even
from skyledger.operators import kpis
from skyledger.params import DEFAULT_PARAMS
from tests.conftest import results

X = F.col("x")
SCHEMA = (
    "AVG_OCCUPANCY_RATE double, TOTAL_FLIGHTS long, AVG_ROUNDTRIP_FARE_PER_PASSENGER double, "
    "ONE_WAY_DISTANCE_MILES double, AIRPORT_A_SIZE string, AIRPORT_B_SIZE string, "
    "AVG_DEP_DELAY_MINUTES double, AVG_ARR_DELAY_MINUTES double"
)


def routes(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_round_half_even(column):
    df = column([0.125, 0.375, 1.005, 2.675, -0.125, None], "double")
    assert results(df, round_half_even(X)) == [0.12, 0.38, 1.0, 2.68, -0.12, None]
    assert results(column([0.5, 1.5, 2.5], "double"), round_half_even(X, 0)) == [0.0, 2.0, 2.0]


def test_excess_delay_cost(column):
    df = column([15.0, 16.0, -5.0, None], "double")
    assert results(df, excess_delay_cost(X)) == [0.0, 75.0, 0.0, None]


def test_airport_fee(column):
    df = column(["medium_airport", "large_airport", "small_airport", None])
    assert results(df, airport_fee(X)) == [5000.0, 10000.0, 10000.0, 10000.0]


def test_ratio_by_zero_is_null(column):
    assert results(column([1.0], "double"), ratio(X, F.lit(0.0))) == [None]


def test_route_kpis_by_hand(spark):
    df = routes(spark, (0.5, 10, 300.0, 100.0, "medium_airport", "large_airport", 20.0, 10.0))
    row = kpis.add_route_kpis(df).first()
    assert row["ESTIMATED_PASSENGERS"] == 1000.0
    assert row["TICKET_REVENUE"] == 300_000.0
    assert row["BAGGAGE_REVENUE"] == 35_000.0
    assert row["TOTAL_REVENUE"] == 335_000.0
    assert row["MILEAGE_COST"] == 18_360.0
    assert row["AIRPORT_FEES"] == 150_000.0
    assert row["DELAY_COST"] == 3_750.0
    assert row["TOTAL_COST"] == 172_110.0
    assert row["PROFIT"] == 162_890.0


def test_missing_delay_makes_profit_missing(spark):
    df = routes(spark, (0.5, 10, 300.0, 100.0, None, "large_airport", None, 10.0))
    row = kpis.add_route_kpis(df).first()
    assert row["AIRPORT_FEES"] == 200_000.0
    assert row["DELAY_COST"] is None and row["TOTAL_COST"] is None and row["PROFIT"] is None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(
    st.floats(0.01, 1), st.integers(1, 5000), st.floats(20, 2000), st.floats(50, 5000),
    st.sampled_from(["medium_airport", "large_airport", None]),
    st.sampled_from(["medium_airport", "large_airport"]),
    st.floats(-60, 200), st.floats(-60, 200)), min_size=1, max_size=30))
def test_parts_add_up(spark, rows):
    k = kpis.add_route_kpis(routes(spark, *rows), rounded=False)
    off = (
        (F.abs(F.col("TOTAL_REVENUE") - F.col("TICKET_REVENUE") - F.col("BAGGAGE_REVENUE")) > 0.01)
        | (F.abs(F.col("PROFIT") + F.col("TOTAL_COST") - F.col("TOTAL_REVENUE")) > 0.01)
        | (F.col("DELAY_COST") < 0)
    )
    assert k.where(off).isEmpty()


def test_ratio_kpis_round_before_the_last_three(spark):
    df = routes(spark, (0.5, 10, 300.0, 100.0, "medium_airport", "large_airport", 1.004, 2.004))
    row = kpis.add_ratio_kpis(kpis.add_route_kpis(df)).first()
    assert row["AVG_DEP_DELAY_MINUTES"] == 1.0
    assert row["TOTAL_DELAY_MINUTES"] == row["DELAY_MINUTES_PER_FLIGHT"] == 3.0
    assert row["PROFIT_MARGIN_PCT"] == pytest.approx(48.4, abs=2)
    assert row["BAGGAGE_REVENUE_PCT"] == pytest.approx(35_000 / 335_000 * 100)


def test_breakeven(spark):
    df = spark.createDataFrame([(90.0, 1), (0.0, 5), (-45.0, 1)], "PROFIT double, TOTAL_FLIGHTS long")
    found = [r["BREAKEVEN_FLIGHTS"] for r in kpis.add_breakeven(df).collect()]
    assert found == [1_000_000.0, None, -2_000_000.0]


def test_growth_and_tracker(spark):
    rows = [("r", "c", "x", 2019, q, 100.0 * q, 45e6) for q in (1, 2, 3)]
    df = spark.createDataFrame(
        rows, "ROUTE string, CARRIER string, ROUTE_NAME_CITY string, YEAR int, QUARTER int, "
        "ESTIMATED_PASSENGERS double, PROFIT double")
    grown = kpis.passenger_growth(df).orderBy("QUARTER").collect()
    assert [r["PASSENGER_GROWTH_PCT"] for r in grown] == [None, 100.0, 50.0]
    tracked = kpis.breakeven_tracker(df).orderBy("QUARTER").collect()
    assert [r["BREAKEVEN_PROGRESS"] for r in tracked] == [0.5, 1.0, 1.5]


def test_growth_is_null_across_a_missing_quarter(spark):
    quarters = [(2019, 1), (2019, 3), (2019, 4), (2020, 1), (2021, 1)]
    rows = [("r", "c", "x", y, q, 100.0 + i) for i, (y, q) in enumerate(quarters)]
    df = spark.createDataFrame(
        rows, "ROUTE string, CARRIER string, ROUTE_NAME_CITY string, YEAR int, QUARTER int, "
        "ESTIMATED_PASSENGERS double")
    grown = kpis.passenger_growth(df).orderBy("YEAR", "QUARTER").collect()
    assert [r["PREVIOUS_PASSENGERS"] for r in grown] == [None, None, 101.0, 102.0, None]


def test_cost_per_mile():
    assert DEFAULT_PARAMS.cost_per_mile == 9.18
    assert DEFAULT_PARAMS.bag_fee_round_trip == 70.0
