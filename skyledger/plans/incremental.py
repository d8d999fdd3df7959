"""Quality control and route KPIs of tables that grow file by file.

What a file tells is worked out once, when it is added, and kept as its part (``sources/parts``).

``QcStore`` keeps a file's converted rows, equal ones once with their number, and partial reports
(failed conversions, rows and nulls by column). Text is parsed when a file is added and never again.
The reports on text and nulls are sums of the parts, which hold a row for each distinct failure or
column. The decisions on the whole table (which columns to filter, fill, drop and cap) are taken
over the converted rows of all files together, by the same steps as for one table, so a merge gives
what a run over all files gives, in any order of arrival.

``RouteStore`` keeps the sums and counts of a file's flights by direction, carrier and period, and
those of its tickets by route, carrier and period. A KPI table, by any of the period columns or
none, is made of the sums alone: neither flights nor tickets are read again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.text import ISO_FORMATS
from skyledger.operators.aggregates import (
    direction_sums,
    directions_of,
    flights_by_route,
    ticket_sums,
    tickets_of,
)
from skyledger.operators.cleaning import (
    all_failed,
    convert_audited,
    error_report,
    merged_error_report,
    to_route_schema,
)
from skyledger.operators.joins import enrich_routes
from skyledger.operators.kpis import add_route_kpis
from skyledger.operators.quality import copies, merged_null_counts, null_counts
from skyledger.params import DEFAULT_PARAMS, RouteParams
from skyledger.plans.qc import QcPlan, QcResult, finish_qc
from skyledger.sources.parts import PartStore
from skyledger.sources.tables import stage

ERRORS = ("errors_before", "errors_after")


@dataclass(frozen=True)
class QcStore(PartStore):
    """Parts of one raw table under one plan."""

    plan: QcPlan
    formats: Sequence[str] = ISO_FORMATS
    number_ids: Sequence[str] = ()

    def add(self, name: str, raw: DataFrame) -> None:
        """Parses one file's rows and keeps what they tell under ``name``."""
        kinds = self.plan.typed_as(self.number_ids)
        parsed = stage(
            convert_audited(raw.select(*kinds), kinds, self.plan.worded, self.formats), "typed"
        )
        typed = parsed.select(*kinds)
        reports = {
            report: error_report(parsed, all_failed("_failed", own))
            for report, own in zip(ERRORS, ("_before", "_after"))
        }
        self.put(name, {"rows": copies(typed, "_copies"), "nulls": null_counts(typed), **reports})

    def merged(
        self, strict: bool = False, numeric_mode: str = "text", exact: bool = True
    ) -> QcResult:
        """Quality control of all files together, from their parts alone."""
        parts = list(self.parts().values())
        nulls = merged_null_counts(self.read("nulls", parts))
        gaps = {
            r["column_name"]: r["null_count"]
            for r in nulls.where(F.col("column_name").isin(*self.plan.allowed)).collect()
        }
        reports = {r: merged_error_report(self.read(r, parts)) for r in ERRORS}
        reports["nulls_before"] = nulls.where("null_count > 0").orderBy(
            F.desc("null_pct"), "column_name"
        )
        rows = self.read("rows", parts)
        repeated = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
        typed = repeated.select(*self.plan.typed_as(self.number_ids))
        return finish_qc(typed, gaps, self.plan, reports, strict, numeric_mode, exact)


@dataclass(frozen=True)
class RouteStore(PartStore):
    """Sums of cleaned flights and tickets, by the columns of ``period`` too."""

    period: Sequence[str] = ()

    def add_flights(self, name: str, flights: DataFrame) -> None:
        self.put(f"flights {name}", {"flights": direction_sums(flights, self.period)})

    def add_tickets(self, name: str, tickets: DataFrame) -> None:
        self.put(f"tickets {name}", {"tickets": ticket_sums(tickets, self.period)})

    def kpis(
        self,
        airports: DataFrame,
        params: RouteParams = DEFAULT_PARAMS,
        period: Sequence[str] = (),
        weighted: bool = False,
    ) -> DataFrame:
        """The KPI table over all files, by ``period``, any of the store's period columns."""
        if not set(period) <= set(self.period):
            raise ValueError(f"{list(period)} is more than the store tells apart: {list(self.period)}")
        parts = list(self.parts().values())
        directions = directions_of(self.read("flights", parts), period)
        sold = tickets_of(self.read("tickets", parts), period)
        routes = enrich_routes(flights_by_route(directions, period, weighted), sold, airports, period)
        return routes.transform(to_route_schema, period).transform(add_route_kpis, params)
