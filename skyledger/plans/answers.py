"""The business answers: rankings of single routes per carrier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from skyledger.operators.aggregates import flights_per_route
from skyledger.operators.kpis import (
    add_breakeven,
    add_profit_million,
    add_revenue_to_cost,
    add_total_delay,
)
from skyledger.operators.ranking import (
    ascending,
    balanced_cost,
    descending,
    medium_large,
    named_routes,
    positive,
    top_k,
)
from skyledger.params import DEFAULT_PARAMS, RouteParams

# How an answer names a route; the columns of each answer, in the order shown, are
# fixed values too.
PLACE = ("ROUTE_NAME_CITY", "AIRPORT_CODE_A", "AIRPORT_CODE_B")

# The city pairs recommended for a first fleet.
RECOMMENDED = (
    "Honolulu, HI -> Kahului, HI",
    "Charlotte, NC -> Wilmington, NC",
    "Charlotte, NC -> Myrtle Beach, SC",
    "Honolulu, HI -> Kona, HI",
    "Honolulu, HI -> Lihue, HI",
)


def busiest(kpis: DataFrame, n: int = 10) -> DataFrame:
    columns = [*PLACE, "TOTAL_FLIGHTS"]
    return kpis.transform(medium_large).transform(top_k, descending("TOTAL_FLIGHTS"), n, columns)


def most_profitable(kpis: DataFrame, n: int = 10) -> DataFrame:
    columns = [
        *PLACE, "TOTAL_FLIGHTS", "TOTAL_REVENUE", "TOTAL_COST", "PROFIT", "TICKET_REVENUE",
        "BAGGAGE_REVENUE", "MILEAGE_COST", "AIRPORT_FEES", "DELAY_COST",
    ]
    return kpis.transform(medium_large).transform(top_k, descending("PROFIT"), n, columns)


def recommended(kpis: DataFrame, n: int = 5) -> DataFrame:
    best = kpis.transform(medium_large).transform(
        top_k, descending("PROFIT"), n, [*PLACE, "PROFIT"]
    )
    return add_profit_million(best)


def most_demanded(kpis: DataFrame, n: int = 5) -> DataFrame:
    columns = [*PLACE, "ESTIMATED_PASSENGERS"]
    order = descending("ESTIMATED_PASSENGERS")
    return kpis.transform(medium_large).transform(top_k, order, n, columns)


def most_punctual(kpis: DataFrame, n: int = 5) -> DataFrame:
    columns = [*PLACE, "AVG_DEP_DELAY_MINUTES", "AVG_ARR_DELAY_MINUTES", "AVG_TOTAL_DELAY"]
    delays = kpis.transform(medium_large).transform(add_total_delay)
    return top_k(delays, ascending("AVG_TOTAL_DELAY"), n, columns)


def busiest_grouped(kpis: DataFrame, n: int = 5) -> DataFrame:
    grouped = kpis.transform(medium_large).transform(flights_per_route)
    return top_k(grouped, descending("TOTAL_FLIGHTS"), n)


def best_revenue_to_cost(kpis: DataFrame, n: int = 5) -> DataFrame:
    columns = [*PLACE, "TOTAL_REVENUE", "TOTAL_COST", "REV_TO_COST_RATIO"]
    costly = kpis.transform(medium_large).transform(positive, "TOTAL_COST")
    return top_k(add_revenue_to_cost(costly), descending("REV_TO_COST_RATIO"), n, columns)


def best_balanced(kpis: DataFrame, n: int = 5, limit: float = 0.7) -> DataFrame:
    columns = [
        "ROUTE_NAME_CITY", "PROFIT", "TOTAL_COST",
        "MILEAGE_COST_PCT", "AIRPORT_FEES_PCT", "DELAY_COST_PCT",
    ]
    balanced = kpis.transform(medium_large).transform(balanced_cost, limit)
    return top_k(balanced, descending("PROFIT"), n, columns)


def breakeven(
    kpis: DataFrame,
    names: Sequence[str] = RECOMMENDED,
    params: RouteParams = DEFAULT_PARAMS,
) -> DataFrame:
    """Flights to earn one airplane on the named city pairs, quickest first."""
    columns = [
        "ROUTE_NAME_CITY", "TOTAL_FLIGHTS", "PROFIT", "PROFIT_PER_FLIGHT",
        "BREAKEVEN_FLIGHTS", "ESTIMATED_PASSENGERS", "AVG_TOTAL_DELAY",
    ]
    named = kpis.transform(named_routes, names).transform(add_breakeven, params)
    ordered = named.transform(add_total_delay).orderBy(
        *ascending("BREAKEVEN_FLIGHTS", "ROUTE", "CARRIER")
    )
    return ordered.select(*columns)


def answers(
    kpis: DataFrame, names: Sequence[str] = RECOMMENDED, params: RouteParams = DEFAULT_PARAMS
) -> dict[str, DataFrame]:
    """Every answer by name. Stage ``kpis`` first: each answer reads it again."""
    return {
        "busiest": busiest(kpis),
        "most_profitable": most_profitable(kpis),
        "recommended": recommended(kpis),
        "most_demanded": most_demanded(kpis),
        "most_punctual": most_punctual(kpis),
        "busiest_grouped": busiest_grouped(kpis),
        "best_revenue_to_cost": best_revenue_to_cost(kpis),
        "best_balanced": best_balanced(kpis),
        "breakeven": breakeven(kpis, names, params),
    }
