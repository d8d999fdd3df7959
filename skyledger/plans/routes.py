"""From cleaned flights, tickets and airports to one KPI row per route and carrier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from skyledger.operators.aggregates import flights_by_direction, flights_by_route, tickets_by_route
from skyledger.operators.cleaning import parse_date_parts, to_route_schema
from skyledger.operators.joins import enrich_routes
from skyledger.operators.kpis import add_ratio_kpis, add_route_kpis
from skyledger.operators.ranking import medium_large
from skyledger.params import DEFAULT_PARAMS, RouteParams

# The columns each cleaned table is read with.
AIRPORT_COLUMNS = ("TYPE", "NAME", "ELEVATION_FT", "MUNICIPALITY", "IATA_CODE", "COORDINATES")
FLIGHT_COLUMNS = (
    "FL_DATE", "OP_CARRIER", "TAIL_NUM", "OP_CARRIER_FL_NUM", "ORIGIN_AIRPORT_ID", "ORIGIN",
    "ORIGIN_CITY_NAME", "DEST_AIRPORT_ID", "DESTINATION", "DEST_CITY_NAME", "DEP_DELAY",
    "ARR_DELAY", "CANCELLED", "AIR_TIME", "DISTANCE", "OCCUPANCY_RATE",
)
TICKET_COLUMNS = (
    "ITIN_ID", "YEAR", "QUARTER", "ORIGIN", "ORIGIN_COUNTRY", "ORIGIN_STATE_ABR",
    "ORIGIN_STATE_NM", "ROUNDTRIP", "REPORTING_CARRIER", "PASSENGERS", "ITIN_FARE", "DESTINATION",
)


def joined_routes(
    flights: DataFrame,
    tickets: DataFrame,
    airports: DataFrame,
    period: Sequence[str] = (),
    weighted: bool = False,
) -> DataFrame:
    """Grouped flights and tickets with both airports, under business names."""
    by_route = flights.transform(flights_by_direction, period).transform(
        flights_by_route, period, weighted
    )
    sold = tickets.transform(tickets_by_route, period)
    return enrich_routes(by_route, sold, airports, period).transform(to_route_schema, period)


def route_kpis(
    flights: DataFrame,
    tickets: DataFrame,
    airports: DataFrame,
    params: RouteParams = DEFAULT_PARAMS,
    period: Sequence[str] = (),
    weighted: bool = False,
) -> DataFrame:
    """The KPI table; with ``period`` columns (in both inputs) one row per period too.

    Lazy from end to end: both inputs are reduced to routes before they are joined.
    """
    if "FL_DATE" in flights.columns and not period:
        flights = flights.transform(parse_date_parts)
    return joined_routes(flights, tickets, airports, period, weighted).transform(
        add_route_kpis, params
    )


def route_kpis_extended(kpis: DataFrame) -> DataFrame:
    """All ratio KPIs of the routes between medium and large airports."""
    return kpis.transform(add_ratio_kpis).transform(medium_large)
