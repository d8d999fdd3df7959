"""Conversion, audit and projection of dirty tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.money import round_half_even
from skyledger.functions.text import (
    ISO_FORMATS,
    clean_numeric,
    conversion_error,
    parse_number,
    parse_timestamp,
    shorten,
)

KINDS = ("string", "float", "int", "date")


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def clean_numeric_columns(
    df: DataFrame, columns: Sequence[str], mode: str = "compat"
) -> DataFrame:
    """Text columns become doubles by ``clean_numeric``; numeric ones pass as doubles."""
    return df.withColumns(
        {
            c: clean_numeric(F.col(c), mode) if is_text(df, c) else F.col(c).cast("double")
            for c in columns
        }
    )


def _converted(df: DataFrame, column: str, kind: str, formats: Sequence[str]) -> Column:
    value, text = F.col(column), is_text(df, column)
    if kind in ("float", "int"):
        return parse_number(value) if text else value.try_cast("double")
    if kind == "date":
        return parse_timestamp(value, formats) if text else value.try_cast("timestamp")
    if kind == "string":
        return F.nullif(value.cast("string"), F.lit("nan"))
    raise ValueError(f"kind of {column!r} must be one of {KINDS}, got {kind!r}")


def audit_conversions(
    df: DataFrame, kinds: Mapping[str, str], formats: Sequence[str] = ISO_FORMATS
) -> DataFrame:
    """Adds ``<c>_converted`` and ``<c>_conversion_success`` for every column of ``kinds``."""
    converted = df.withColumns(
        {f"{c}_converted": _converted(df, c, kind, formats) for c, kind in kinds.items()}
    )
    return converted.withColumns(
        {f"{c}_conversion_success": F.col(f"{c}_converted").isNotNull() for c in kinds}
    )


def failed_cells(
    df: DataFrame, kinds: Mapping[str, str], formats: Sequence[str] = ISO_FORMATS
) -> Column:
    """The cells of a row that do not convert: column, text, and whether the column is text."""
    cells = []
    for c, kind in kinds.items():
        cell = F.struct(
            F.lit(c).alias("column_name"),
            F.col(c).cast("string").alias("raw"),
            F.lit(is_text(df, c)).alias("is_text"),
        )
        cells.append(F.when(_converted(df, c, kind, formats).isNull(), cell))
    return F.array_compact(F.array(*cells))


FAILED = "array<struct<column_name:string,raw:string,is_text:boolean>>"


def all_failed(*columns: str) -> Column:
    """The failed cells of several columns of ``convert_audited`` as one array."""
    return F.concat(*[F.coalesce(F.col(c), F.array().cast(FAILED)) for c in columns])


def convert_audited(
    df: DataFrame,
    kinds: Mapping[str, str],
    worded: Sequence[str] = (),
    formats: Sequence[str] = ISO_FORMATS,
) -> DataFrame:
    """Columns of ``kinds`` converted, those of ``worded`` by ``clean_numeric``, and the cells
    that failed: ``_failed`` in the other columns, ``_before`` in ``worded`` ones as plain
    numbers, and ``_after`` in them as number words.

    Every cell is parsed once in each way; failures are told from the parsed values.
    """
    parsed = df.select(
        *[F.col(c).alias(f"_raw_{c}") for c in kinds],
        *[_converted(df, c, kind, formats).alias(f"_plain_{c}") for c, kind in kinds.items()],
        *[
            (clean_numeric(F.col(c)) if is_text(df, c) else F.col(c).cast("double")).alias(
                f"_words_{c}"
            )
            for c in worded
        ],
    )

    def failed(columns: Sequence[str], way: str, raw: bool) -> Column:
        """The failed cells; null in a row without any, for which nothing is put together."""
        cells, missing = [], F.lit(False)
        for c in columns:
            text = F.col(f"_raw_{c}").cast("string") if raw else F.lit(None).cast("string")
            cell = F.struct(
                F.lit(c).alias("column_name"),
                text.alias("raw"),
                F.lit(raw and is_text(df, c)).alias("is_text"),
            )
            gone = F.col(f"_{way}_{c}").isNull()
            missing = missing | gone
            cells.append(F.when(gone, cell))
        if not cells:
            return F.lit(None).cast(FAILED)
        return F.when(missing, F.array_compact(F.array(*cells)))

    rest = [c for c in kinds if c not in worded]
    return parsed.select(
        *[F.col(f"_words_{c}" if c in worded else f"_plain_{c}").alias(c) for c in kinds],
        failed(rest, "plain", True).alias("_failed"),
        failed(worded, "plain", True).alias("_before"),
        failed(worded, "words", False).alias("_after"),
    )


def cell_error() -> Column:
    """Why the failed cell of columns ``raw`` and ``is_text`` did not convert."""
    raw, nothing = F.col("raw"), F.lit(None)
    return F.when(F.col("is_text"), conversion_error(raw, nothing)).otherwise(
        conversion_error(raw, nothing, raw_is_text=False)
    )


def error_report(df: DataFrame, cells: Column) -> DataFrame:
    """Distinct failures per column with their number of rows, whole and shortened detail.

    Only failed cells are classified, and equal failures are combined before the shuffle.
    """
    return (
        df.select(F.inline(cells))
        .select("column_name", cell_error().alias("error"))
        .groupBy("column_name", "error.error_type", "error.detail")
        .agg(F.count("*").alias("row_count"))
        .withColumn("printed_detail", shorten(F.col("detail")))
    )


def merged_error_report(reports: DataFrame) -> DataFrame:
    """``error_report`` of a whole table from those of its parts, laid under each other."""
    return (
        reports.groupBy("column_name", "error_type", "detail")
        .agg(F.sum("row_count").alias("row_count"))
        .withColumn("printed_detail", shorten(F.col("detail")))
    )


def conversion_error_report(
    df: DataFrame, kinds: Mapping[str, str], formats: Sequence[str] = ISO_FORMATS
) -> DataFrame:
    """``error_report`` of every cell of ``kinds`` that does not convert."""
    return error_report(df, failed_cells(df, kinds, formats))


def convert_columns(
    df: DataFrame, kinds: Mapping[str, str], formats: Sequence[str] = ISO_FORMATS
) -> DataFrame:
    """Every column of ``kinds`` replaced by its conversion, failures null."""
    return df.withColumns({c: _converted(df, c, kind, formats) for c, kind in kinds.items()})


# Fill per declared kind.
TYPE_FILLS = {"float": 0.0, "string": "Unknown", "date": "1970-01-01 00:00:00"}


def fill_by_type(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Nulls of one column filled by declared kind; an unknown kind changes nothing."""
    if kind not in TYPE_FILLS:
        return df
    fill = F.lit(TYPE_FILLS[kind]).cast(df.schema[column].dataType)
    return df.withColumn(column, F.coalesce(F.col(column), fill))


def parse_date_parts(
    df: DataFrame, column: str = "FL_DATE", formats: Sequence[str] = ISO_FORMATS
) -> DataFrame:
    """The date column parsed (failures null), plus YEAR and MONTH."""
    value = F.col(column)
    if is_text(df, column):
        value = parse_timestamp(value, formats)
    return df.withColumn(column, value).withColumns(
        {"YEAR": F.year(column), "MONTH": F.month(column)}
    )


def round_money(df: DataFrame, columns: Sequence[str] | None = None, scale: int = 2) -> DataFrame:
    """Half-even rounding of the named columns, or of every double column."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: round_half_even(F.col(c), scale) for c in columns})


# Business names of the joined route columns.
ROUTE_SCHEMA = {
    "ROUTE_KEY": "ROUTE",
    "OP_CARRIER": "CARRIER",
    "ROUTE_NAME_CITY": "ROUTE_NAME_CITY",
    "DISTANCE": "ONE_WAY_DISTANCE_MILES",
    "OCCUPANCY_RATE": "AVG_OCCUPANCY_RATE",
    "DEP_DELAY": "AVG_DEP_DELAY_MINUTES",
    "ARR_DELAY": "AVG_ARR_DELAY_MINUTES",
    "TOTAL_FLIGHTS": "TOTAL_FLIGHTS",
    "REPORTING_CARRIER": "CARRIER_FROM_TICKETS",
    "PASSENGERS": "TOTAL_PASSENGERS",
    "ITIN_FARE": "AVG_ROUNDTRIP_FARE_PER_PASSENGER",
    "AIRPORT_A": "AIRPORT_CODE_A",
    "AIRPORT_B": "AIRPORT_CODE_B",
    "AIRPORT_A_TYPE": "AIRPORT_A_SIZE",
    "AIRPORT_A_NAME": "AIRPORT_A_NAME",
    "AIRPORT_A_ELEVATION_FT": "AIRPORT_A_ELEVATION_FT",
    "AIRPORT_A_MUNICIPALITY": "AIRPORT_A_CITY",
    "AIRPORT_A_COORDINATES": "AIRPORT_A_COORDINATES",
    "AIRPORT_B_TYPE": "AIRPORT_B_SIZE",
    "AIRPORT_B_NAME": "AIRPORT_B_NAME",
    "AIRPORT_B_ELEVATION_FT": "AIRPORT_B_ELEVATION_FT",
    "AIRPORT_B_MUNICIPALITY": "AIRPORT_B_CITY",
    "AIRPORT_B_COORDINATES": "AIRPORT_B_COORDINATES",
}


def to_route_schema(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Joined route columns under their business names; ``keep`` passes others through."""
    return df.select(*keep, *[F.col(c).alias(name) for c, name in ROUTE_SCHEMA.items()])
