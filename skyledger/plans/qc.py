"""Quality control of the three raw tables, from text columns to a cleaned typed table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.money import ratio
from skyledger.functions.text import ISO_FORMATS
from skyledger.operators.cleaning import all_failed, convert_audited, error_report
from skyledger.operators.outliers import clip_columns, mad_bounds, mad_report, outlier_summary
from skyledger.operators.quality import (
    DRAWN,
    classify_columns,
    column_profile,
    copies,
    facts_and_kinds,
    fill,
    fill_values,
    filter_allowed,
    impute,
    kind_measures,
    null_counts,
    null_profile,
    numeric_columns,
    with_drawn,
)
from skyledger.operators.quantiles import exact_quantiles
from skyledger.params import LARGE, MEDIUM
from skyledger.sources.audit import AuditStore
from skyledger.sources.tables import stage_measured

UNKNOWN = "Unknown"

# Expected kind of each raw column, and the rows that are kept.
AIRPORT_KINDS = {
    "TYPE": "string", "NAME": "string", "ELEVATION_FT": "float", "CONTINENT": "string",
    "ISO_COUNTRY": "string", "MUNICIPALITY": "string", "IATA_CODE": "string",
    "COORDINATES": "string",
}
AIRPORT_ALLOWED = {"TYPE": [MEDIUM, LARGE], "ISO_COUNTRY": ["US"]}
FLIGHT_KINDS = {
    "FL_DATE": "date", "OP_CARRIER": "string", "TAIL_NUM": "string",
    "OP_CARRIER_FL_NUM": "string", "ORIGIN_AIRPORT_ID": "string", "ORIGIN": "string",
    "ORIGIN_CITY_NAME": "string", "DEST_AIRPORT_ID": "string", "DESTINATION": "string",
    "DEST_CITY_NAME": "string", "DEP_DELAY": "float", "ARR_DELAY": "float", "CANCELLED": "float",
    "AIR_TIME": "float", "DISTANCE": "float", "OCCUPANCY_RATE": "float",
}
FLIGHT_ALLOWED = {"CANCELLED": [0.0]}
TICKET_KINDS = {
    "ITIN_ID": "string", "YEAR": "string", "QUARTER": "string", "ORIGIN": "string",
    "ORIGIN_COUNTRY": "string", "ORIGIN_STATE_ABR": "string", "ORIGIN_STATE_NM": "string",
    "ROUNDTRIP": "float", "REPORTING_CARRIER": "string", "PASSENGERS": "int",
    "ITIN_FARE": "float", "DESTINATION": "string",
}
TICKET_ALLOWED = {"ROUNDTRIP": [1.0]}


@dataclass(frozen=True)
class QcResult:
    """The cleaned table, its reports as DataFrames, and what was decided on the way."""

    cleaned: DataFrame
    reports: dict[str, DataFrame] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    capped: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class QcPlan:
    kinds: Mapping[str, str]
    worded: Sequence[str]
    allowed: Mapping[str, Sequence[object]]
    final_strategy: str
    k: float
    null_threshold: float = 99.0
    classify_raw: bool = False

    def typed_as(self, number_ids: Sequence[str] = ()) -> dict[str, str]:
        return {**self.kinds, **{c: "float" for c in number_ids}}


AIRPORT_PLAN = QcPlan(
    AIRPORT_KINDS, ("ELEVATION_FT",), AIRPORT_ALLOWED, "mean", 1.0, classify_raw=True
)
FLIGHT_PLAN = QcPlan(
    FLIGHT_KINDS, ("AIR_TIME", "DISTANCE", "OCCUPANCY_RATE"), FLIGHT_ALLOWED, "mean", 3.0
)
TICKET_PLAN = QcPlan(
    TICKET_KINDS, ("ROUNDTRIP", "PASSENGERS", "ITIN_FARE"), TICKET_ALLOWED, "median", 3.0
)


def run_qc(
    raw: DataFrame,
    plan: QcPlan,
    strict: bool = False,
    numeric_mode: str = "text",
    number_ids: Sequence[str] = (),
    formats: Sequence[str] = ISO_FORMATS,
    exact: bool = True,
    profile: bool = False,
    audit: str | None = None,
    audit_keys: Sequence[str] = (),
) -> QcResult:
    """Audit, convert, filter, impute, drop, deduplicate, impute again, cap.

    The table is staged as Parquet twice: after conversion, so the text is parsed once, with
    the cells that failed next to it for the error reports, and after deduplication, so its shuffle runs once. What the next decisions need is measured
    while the tables are written.

    ``number_ids`` names declared-text columns to treat as numbers, capping included;
    none by default, since capping an identifier destroys it. ``formats`` are the date formats
    tried in order. ``profile`` adds a profile of the converted columns, at the price of a
    few more passes. ``audit`` names a folder where the failed cells are kept (``AuditStore``,
    steps ``before`` and ``after``), with the columns of ``audit_keys``; the error reports read
    that folder alone.
    """
    kinds = plan.typed_as(number_ids)
    parsed, gaps = stage_measured(
        convert_audited(raw.select(*kinds), kinds, plan.worded, formats),
        "typed",
        [F.count_if(F.col(c).isNull()).alias(c) for c in plan.allowed],
    )
    typed = parsed.select(*kinds)
    failed = {step: all_failed("_failed", f"_{step}") for step in ("before", "after")}
    if audit:
        store = AuditStore(raw.sparkSession, audit)
        store.write(parsed, failed, audit_keys)
        reports = {f"errors_{step}": store.report(step) for step in failed}
    else:
        reports = {f"errors_{step}": error_report(parsed, cells) for step, cells in failed.items()}
    if profile:
        reports["profile"] = column_profile(typed, exact=exact)
    reports["nulls_before"] = null_profile(typed)
    return finish_qc(typed, gaps, plan, reports, strict, numeric_mode, exact)


def finish_qc(
    typed: DataFrame,
    gaps: Mapping[str, int],
    plan: QcPlan,
    reports: dict[str, DataFrame],
    strict: bool = False,
    numeric_mode: str = "text",
    exact: bool = True,
) -> QcResult:
    """Filter, impute, drop, deduplicate, impute again, cap a converted table.

    ``gaps`` counts the nulls of the columns that the plan filters; ``reports`` are those made
    of the text already.
    """
    unsure = [c for c in plan.allowed if gaps[c]]
    chosen = filter_allowed(typed, plan.allowed, unsure, strict)
    filtered = impute(
        chosen.rows, chosen.numerical, chosen.categorical, "median", "constant", UNKNOWN,
        numeric_mode, exact,
    )

    empty = null_counts(filtered).where("total_count > 0").where(
        (F.col("null_count") == F.col("total_count")) | (F.col("null_pct") > plan.null_threshold)
    )
    dropped = [r["column_name"] for r in empty.collect()]
    kept = filtered.drop(*dropped)

    distinct, measured = stage_measured(
        with_drawn(copies(kept, "copy_count"), kept.columns), "distinct", kind_measures(kept)
    )
    n = F.col("copy_count")
    reports["duplicates"] = distinct.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_count"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("duplicate_count"),
    ).withColumn("duplicate_pct", ratio(F.col("duplicate_count"), F.col("total_count")) * 100)
    unique = distinct.drop("copy_count", DRAWN)

    reports["nulls_after"] = null_profile(unique)
    facts, kinds_now = facts_and_kinds(unique, measured=measured)
    gappy = [[c for c in kind if c in facts.gaps] for kind in (kinds_now.numerical, kinds_now.categorical)]
    fills = fill_values(unique, *gappy, plan.final_strategy, "constant", UNKNOWN, exact, facts)
    full = fill(unique, fills, *gappy, "constant", numeric_mode)

    # Filling a numerical column cannot make it categorical, so its kind still holds.
    wide = classify_columns(typed).numerical if plan.classify_raw else kinds_now.numerical
    numbers = set(numeric_columns(full))
    outlier_cols = [c for c in wide if c in numbers]
    if not outlier_cols:
        return QcResult(full, reports, dropped, [])
    # A mean or median lies between the ends, so filling moves neither.
    ends = {
        c: e.filled(fills.get(c), facts.nulls[c]) if c in kinds_now.numerical else e
        for c, e in facts.extents.items()
        if c in outlier_cols
    }
    quartiles = exact_quantiles(
        full, {c: [0.25, 0.5, 0.75] for c in outlier_cols}, exact=exact, extents=ends
    )
    reports["outliers"] = outlier_summary(
        full, outlier_cols, "iqr", quartiles={c: (q[0], q[2]) for c, q in quartiles.items()}
    )
    bounds = mad_bounds(
        full, outlier_cols, plan.k, medians={c: q[1] for c, q in quartiles.items()}, exact=exact,
        extents=ends,
    )
    reports["capping"] = mad_report(full, bounds)
    return QcResult(clip_columns(full, bounds), reports, dropped, outlier_cols)


def clean_airports(raw: DataFrame, **options) -> QcResult:
    """Medium and large airports of the US; elevation capped at one MAD."""
    return run_qc(raw, AIRPORT_PLAN, **options)


def clean_flights(raw: DataFrame, **options) -> QcResult:
    """Flights that were not cancelled; means fill the gaps, three MADs cap."""
    return run_qc(raw, FLIGHT_PLAN, **options)


def clean_tickets(raw: DataFrame, **options) -> QcResult:
    """Round-trip tickets; medians fill the gaps, three MADs cap.

    A column without spread is left alone anyway: it has too few values to be numerical.
    """
    return run_qc(raw, TICKET_PLAN, **options)
