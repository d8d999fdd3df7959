"""Exploration of medium-large routes: the data sets behind each chart.

Functions take the rows already restricted to medium-large routes; those that rank ratio
KPIs take the extended KPI table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.text import latitude, longitude
from skyledger.operators.aggregates import delay_metrics, route_summary, sum_by_route
from skyledger.operators.ranking import (
    Ranking,
    ascending,
    best_per_group,
    descending,
    first_stored,
    positive,
    sweet_spot,
    top_each,
    top_k,
)
from skyledger.params import DEFAULT_SWEET_SPOT, SweetSpot

CITY = "ROUTE_NAME_CITY"

# The measures that are described.
DESCRIBED = (
    "ONE_WAY_DISTANCE_MILES", "AVG_OCCUPANCY_RATE", "AVG_DEP_DELAY_MINUTES",
    "AVG_ARR_DELAY_MINUTES", "TOTAL_FLIGHTS", "TOTAL_PASSENGERS",
    "AVG_ROUNDTRIP_FARE_PER_PASSENGER", "TICKET_REVENUE", "BAGGAGE_REVENUE", "TOTAL_REVENUE",
    "ROUND_TRIP_DISTANCE_MILES", "MILEAGE_COST", "AIRPORT_FEES", "DELAY_COST", "TOTAL_COST",
    "PROFIT", "ESTIMATED_PASSENGERS",
)


def top_cities(routes: DataFrame, metric: str, n: int = 10) -> DataFrame:
    """City pairs with the largest sum of ``metric``."""
    return top_k(sum_by_route(routes, metric), descending(metric), n)


def least_delayed_cities(routes: DataFrame, n: int = 15) -> DataFrame:
    delays = delay_metrics(routes).select(CITY, "AVG_TOTAL_DELAY_MINUTES")
    return top_k(delays, ascending("AVG_TOTAL_DELAY_MINUTES"), n)


def top_with_coordinates(routes: DataFrame, n: int = 10) -> DataFrame:
    """Routes with the most passengers and the position of both ends."""
    ends = {
        f"{name}_{side}": read(F.col(f"AIRPORT_{side}_COORDINATES"))
        for side in ("A", "B")
        for name, read in (("LON", longitude), ("LAT", latitude))
    }
    best = top_k(routes, descending("ESTIMATED_PASSENGERS"), n)
    return best.withColumns(ends).select(CITY, "ESTIMATED_PASSENGERS", *ends)


def best_sweet_spots(
    routes: DataFrame, n: int = 10, limits: SweetSpot = DEFAULT_SWEET_SPOT
) -> DataFrame:
    found = sweet_spot(route_summary(routes), limits)
    return top_k(found, descending("PROFIT", "ESTIMATED_PASSENGERS"), n)


def best_cities(routes: DataFrame, metric: str, columns: list[str], n: int = 10) -> DataFrame:
    """The best row of each city pair by ``metric``, and the best ``n`` of those."""
    best = best_per_group(routes, [CITY], descending(metric))
    return top_k(best, descending(metric), n, [CITY, *columns])


def revenue_mix(routes: DataFrame, n: int = 10) -> DataFrame:
    return best_cities(routes, "PROFIT", ["TICKET_REVENUE", "BAGGAGE_REVENUE"], n)


def cost_breakdown(routes: DataFrame, n: int = 10) -> DataFrame:
    return best_cities(routes, "PROFIT", ["MILEAGE_COST", "AIRPORT_FEES", "DELAY_COST"], n)


def costliest_delays(routes: DataFrame, n: int = 10) -> DataFrame:
    return best_cities(routes, "DELAY_COST", ["DELAY_COST"], n)


def highest_fares(routes: DataFrame, n: int = 10) -> DataFrame:
    """The first stored row of each city pair, ranked by fare."""
    fare = "AVG_ROUNDTRIP_FARE_PER_PASSENGER"
    return top_k(first_stored(routes), descending(fare), n, [CITY, fare])


def distance_and_cost(routes: DataFrame) -> DataFrame:
    columns = [CITY, "ROUND_TRIP_DISTANCE_MILES", "TOTAL_COST", "ESTIMATED_PASSENGERS"]
    return first_stored(routes).select(*columns)


def worst_delays(routes: DataFrame, by: str = "AVG_TOTAL_DELAY_MINUTES", n: int = 10) -> DataFrame:
    """City pairs with the longest mean delay or the largest ``DELAY_COST``."""
    return top_k(delay_metrics(routes), descending(by), n)


def top_by(extended: DataFrame, metric: str, n: int = 10, also: tuple[str, ...] = ()) -> DataFrame:
    """Routes with the largest ``metric``, with companion columns."""
    columns = [CITY, "CARRIER", metric, *also]
    return top_k(extended, descending(metric), n, columns)


# The ratio KPIs that routes are ranked by, with the length of each list.
LEADERS = {
    "PROFIT_MARGIN_PCT": 10, "PROFIT_PER_FLIGHT": 10, "PROFIT_PER_PASSENGER": 10,
    "REVENUE_PER_PASSENGER": 10, "BAGGAGE_REVENUE_PCT": 10, "FLIGHTS_PER_1000_MILES": 10,
    "PROFIT": 10, "ESTIMATED_PASSENGERS": 50,
}


def leaders(extended: DataFrame) -> DataFrame:
    """All lists of ``top_by`` from one pass, named after their metric."""
    return top_each(extended, {c: Ranking((c,), n) for c, n in LEADERS.items()})


def occupancy_and_distance(routes: DataFrame) -> DataFrame:
    return routes.select(
        CITY, "ONE_WAY_DISTANCE_MILES", "AVG_OCCUPANCY_RATE", "ESTIMATED_PASSENGERS"
    )


def cost_and_revenue(routes: DataFrame) -> DataFrame:
    """Points against the break-even diagonal."""
    return positive(routes, "TOTAL_COST", "TOTAL_REVENUE").select(
        CITY, "TOTAL_COST", "TOTAL_REVENUE", "ESTIMATED_PASSENGERS",
        (F.col("TOTAL_REVENUE") > F.col("TOTAL_COST")).alias("ABOVE_BREAKEVEN"),
    )

