"""Grouped flights and tickets kept in buckets of route and carrier, where KPIs read them.

A KPI table for other airports or other parameters then joins them where they lie: neither side is
shuffled again. Flights and tickets are reduced first, so a route with a third of all flights is one
row of its bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from skyledger.operators.aggregates import flights_by_direction, flights_by_route, tickets_by_route
from skyledger.operators.cleaning import parse_date_parts, to_route_schema
from skyledger.operators.joins import enrich_routes
from skyledger.operators.kpis import add_route_kpis
from skyledger.params import DEFAULT_PARAMS, RouteParams
from skyledger.sources.tables import write_bucketed


@dataclass(frozen=True)
class RouteTables:
    """Two bucketed tables, ``<name>_flights`` and ``<name>_tickets``, below ``folder``.

    ``buckets`` sets how many tasks join them; ``period`` columns are kept, and joined on, too.
    """

    spark: SparkSession
    name: str
    folder: str
    buckets: int
    period: Sequence[str] = ()

    def write_flights(self, flights: DataFrame, weighted: bool = False) -> DataFrame:
        if "FL_DATE" in flights.columns and not self.period:
            flights = flights.transform(parse_date_parts)
        grouped = flights.transform(flights_by_direction, self.period).transform(
            flights_by_route, self.period, weighted
        )
        return self._write(grouped, "flights", "OP_CARRIER")

    def write_tickets(self, tickets: DataFrame) -> DataFrame:
        grouped = tickets.transform(tickets_by_route, self.period)
        return self._write(grouped, "tickets", "REPORTING_CARRIER")

    def _write(self, grouped: DataFrame, kind: str, carrier: str) -> DataFrame:
        keys = ["ROUTE_KEY", carrier, *self.period]
        path = f"{self.folder}/{kind}"
        return write_bucketed(grouped, f"{self.name}_{kind}", path, keys, self.buckets)

    def flights(self) -> DataFrame:
        return self.spark.table(f"{self.name}_flights")

    def tickets(self) -> DataFrame:
        return self.spark.table(f"{self.name}_tickets")

    def kpis(self, airports: DataFrame, params: RouteParams = DEFAULT_PARAMS) -> DataFrame:
        """The KPI table of ``route_kpis``."""
        joined = enrich_routes(self.flights(), self.tickets(), airports, self.period)
        return joined.transform(to_route_schema, self.period).transform(add_route_kpis, params)

    def drop(self) -> None:
        """Forgets both tables; the files below ``folder`` stay."""
        for kind in ("flights", "tickets"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}")
