"""From raw CSV files to the KPI table, with a written table between stages."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from skyledger.params import DEFAULT_PARAMS, RouteParams
from skyledger.plans.qc import QcResult, clean_airports, clean_flights, clean_tickets
from skyledger.plans.routes import AIRPORT_COLUMNS, FLIGHT_COLUMNS, TICKET_COLUMNS, route_kpis
from skyledger.sources.tables import read_clean, read_raw_csv, write_table

CLEANERS = {"flights": clean_flights, "tickets": clean_tickets, "airports": clean_airports}
COLUMNS = {
    "flights": FLIGHT_COLUMNS,
    "tickets": TICKET_COLUMNS,
    "airports": AIRPORT_COLUMNS,
}


@dataclass(frozen=True)
class Tables:
    """Where a run keeps its tables, below one folder."""

    folder: str

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"


def clean_files(
    spark: SparkSession, raw: Mapping[str, str], tables: Tables, **options
) -> dict[str, QcResult]:
    """Every raw CSV file through its quality control, cleaned tables written as Parquet.

    ``raw`` names the file of ``flights``, ``tickets`` and, unless it is clean already,
    ``airports``. The reports come back unread.
    """
    results = {}
    for name, path in raw.items():
        results[name] = CLEANERS[name](read_raw_csv(spark, path), **options)
        write_table(results[name].cleaned, tables.path(name), mark_nan=True)
    return results


def kpi_file(
    spark: SparkSession, tables: Tables, params: RouteParams = DEFAULT_PARAMS
) -> DataFrame:
    """The KPI table of the cleaned tables, written and read back."""
    flights, tickets, airports = (
        read_clean(spark, tables.path(name), columns) for name, columns in COLUMNS.items()
    )
    write_table(route_kpis(flights, tickets, airports, params), tables.path("kpis"))
    return spark.read.parquet(tables.path("kpis"))
