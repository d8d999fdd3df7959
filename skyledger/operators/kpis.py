"""The route model: revenue, cost, profit and the ratios built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.money import airport_fee, excess_delay_cost, ratio, round_half_even
from skyledger.operators.cleaning import round_money
from skyledger.params import DEFAULT_PARAMS, RouteParams

MONEY = (
    "TICKET_REVENUE", "BAGGAGE_REVENUE", "TOTAL_REVENUE", "MILEAGE_COST",
    "AIRPORT_FEES", "DELAY_COST", "TOTAL_COST", "PROFIT",
)


def add_revenue(df: DataFrame, params: RouteParams = DEFAULT_PARAMS) -> DataFrame:
    """Passengers estimated from occupancy, and what they pay."""
    passengers = F.col("ESTIMATED_PASSENGERS")
    return (
        df.withColumn(
            "ESTIMATED_PASSENGERS",
            F.col("AVG_OCCUPANCY_RATE") * params.seats_per_flight * F.col("TOTAL_FLIGHTS"),
        )
        .withColumns(
            {
                "TICKET_REVENUE": passengers * F.col("AVG_ROUNDTRIP_FARE_PER_PASSENGER"),
                "BAGGAGE_REVENUE": passengers * params.bag_share * params.bag_fee_round_trip,
            }
        )
        .withColumn("TOTAL_REVENUE", F.col("TICKET_REVENUE") + F.col("BAGGAGE_REVENUE"))
    )


def add_costs(df: DataFrame, params: RouteParams = DEFAULT_PARAMS) -> DataFrame:
    """Mileage, landing fees and delay, for every flight of the route."""
    flights = F.col("TOTAL_FLIGHTS")
    fees = airport_fee(F.col("AIRPORT_A_SIZE"), params) + airport_fee(
        F.col("AIRPORT_B_SIZE"), params
    )
    delay = excess_delay_cost(F.col("AVG_DEP_DELAY_MINUTES"), params) + excess_delay_cost(
        F.col("AVG_ARR_DELAY_MINUTES"), params
    )
    return (
        df.withColumn("ROUND_TRIP_DISTANCE_MILES", F.col("ONE_WAY_DISTANCE_MILES") * 2)
        .withColumns(
            {
                "MILEAGE_COST": F.col("ROUND_TRIP_DISTANCE_MILES") * params.cost_per_mile * flights,
                "AIRPORT_FEES": fees * flights,
                "DELAY_COST": delay * flights,
            }
        )
        .withColumn(
            "TOTAL_COST", F.col("MILEAGE_COST") + F.col("AIRPORT_FEES") + F.col("DELAY_COST")
        )
    )


def add_route_kpis(
    df: DataFrame, params: RouteParams = DEFAULT_PARAMS, rounded: bool = True
) -> DataFrame:
    """Revenue, cost and profit; money rounded to cents at the very end."""
    full = (
        df.transform(add_revenue, params)
        .transform(add_costs, params)
        .withColumn("PROFIT", F.col("TOTAL_REVENUE") - F.col("TOTAL_COST"))
    )
    return round_money(full, MONEY) if rounded else full


def add_margin(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "PROFIT_MARGIN_PCT", ratio(F.col("PROFIT"), F.col("TOTAL_REVENUE")) * 100
    )


def add_per_passenger(df: DataFrame) -> DataFrame:
    passengers = F.col("ESTIMATED_PASSENGERS")
    return df.withColumns(
        {
            "COST_PER_PASSENGER": ratio(F.col("TOTAL_COST"), passengers),
            "REVENUE_PER_PASSENGER": ratio(F.col("TOTAL_REVENUE"), passengers),
            "PROFIT_PER_PASSENGER": ratio(F.col("PROFIT"), passengers),
        }
    )


def add_frequency(df: DataFrame) -> DataFrame:
    thousands = F.col("ROUND_TRIP_DISTANCE_MILES") / 1000
    return df.withColumn("FLIGHTS_PER_1000_MILES", ratio(F.col("TOTAL_FLIGHTS"), thousands))


def add_cost_shares(df: DataFrame, percent: bool = True) -> DataFrame:
    """Share of each cost in the total, in percent or as a fraction."""
    scale = 100 if percent else 1
    return df.withColumns(
        {
            f"{c}_PCT": ratio(F.col(c), F.col("TOTAL_COST")) * scale
            for c in ("MILEAGE_COST", "AIRPORT_FEES", "DELAY_COST")
        }
    )


def add_per_flight(df: DataFrame) -> DataFrame:
    flights = F.col("TOTAL_FLIGHTS")
    return df.withColumns(
        {
            "PASSENGERS_PER_FLIGHT": ratio(F.col("ESTIMATED_PASSENGERS"), flights),
            "REVENUE_PER_FLIGHT": ratio(F.col("TOTAL_REVENUE"), flights),
            "PROFIT_PER_FLIGHT": ratio(F.col("PROFIT"), flights),
            "COST_PER_FLIGHT": ratio(F.col("TOTAL_COST"), flights),
        }
    )


def add_total_delay(df: DataFrame, name: str = "AVG_TOTAL_DELAY") -> DataFrame:
    return df.withColumn(name, F.col("AVG_DEP_DELAY_MINUTES") + F.col("AVG_ARR_DELAY_MINUTES"))


def add_baggage_share(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "BAGGAGE_REVENUE_PCT", ratio(F.col("BAGGAGE_REVENUE"), F.col("TOTAL_REVENUE")) * 100
    )


def add_breakeven(df: DataFrame, params: RouteParams = DEFAULT_PARAMS) -> DataFrame:
    """Flights needed to earn one airplane."""
    per_flight = ratio(F.col("PROFIT"), F.col("TOTAL_FLIGHTS"))
    flights = ratio(F.lit(params.airplane_cost), F.col("PROFIT_PER_FLIGHT"))
    return df.withColumn("PROFIT_PER_FLIGHT", per_flight).withColumn(
        "BREAKEVEN_FLIGHTS", round_half_even(flights, 0)
    )


def add_revenue_to_cost(df: DataFrame) -> DataFrame:
    return df.withColumn("REV_TO_COST_RATIO", ratio(F.col("TOTAL_REVENUE"), F.col("TOTAL_COST")))


def add_profit_million(df: DataFrame) -> DataFrame:
    return df.withColumn("PROFIT_MILLION", F.col("PROFIT") / 1e6)


def add_occupancy(df: DataFrame, params: RouteParams = DEFAULT_PARAMS) -> DataFrame:
    """Occupancy rate back from passengers and seats."""
    seats = F.col("TOTAL_FLIGHTS") * params.seats_per_flight
    return df.withColumn("OCCUPANCY_RATE", ratio(F.col("ESTIMATED_PASSENGERS"), seats))


def add_ratio_kpis(df: DataFrame, rounded: bool = True) -> DataFrame:
    """All ratio KPIs; every double is rounded before the last three are formed."""
    ratios = (
        df.transform(add_margin)
        .transform(add_per_passenger)
        .transform(add_frequency)
        .transform(add_cost_shares)
        .transform(add_per_flight)
    )
    if rounded:
        ratios = round_money(ratios)
    return (
        ratios.transform(add_total_delay, "DELAY_MINUTES_PER_FLIGHT")
        .transform(add_baggage_share)
        .transform(add_total_delay, "TOTAL_DELAY_MINUTES")
    )


def passenger_growth(
    df: DataFrame,
    group: Sequence[str] = ("ROUTE", "CARRIER", "ROUTE_NAME_CITY"),
    period: tuple[str, str] = ("YEAR", "QUARTER"),
    periods_per_year: int = 4,
) -> DataFrame:
    """Percent change of passengers against the quarter before of the same route.

    Null where that quarter is missing; the last one that is known does not stand in for it.
    ``period`` names the year and the number, from 1, of the period in it.
    """
    order = Window.partitionBy(*group).orderBy(*period)
    year, part = (F.col(c).cast("long") for c in period)
    number = year * periods_per_year + part
    follows = F.lag(number).over(order) == number - 1
    before = F.when(follows, F.lag("ESTIMATED_PASSENGERS").over(order))
    return df.withColumn("PREVIOUS_PASSENGERS", before).withColumn(
        "PASSENGER_GROWTH_PCT",
        ratio(
            F.col("ESTIMATED_PASSENGERS") - F.col("PREVIOUS_PASSENGERS"),
            F.col("PREVIOUS_PASSENGERS"),
        )
        * 100,
    )


def breakeven_tracker(
    df: DataFrame,
    params: RouteParams = DEFAULT_PARAMS,
    group: Sequence[str] = ("ROUTE", "CARRIER", "ROUTE_NAME_CITY"),
    period: Sequence[str] = ("YEAR", "QUARTER"),
) -> DataFrame:
    """Profit so far, in whole cents like its parts, and as a share of the airplane price."""
    so_far = (
        Window.partitionBy(*group)
        .orderBy(*period)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    total = round_half_even(F.sum("PROFIT").over(so_far))
    return df.withColumn("CUMULATIVE_PROFIT", total).withColumn(
        "BREAKEVEN_PROGRESS", F.col("CUMULATIVE_PROFIT") / params.airplane_cost
    )
