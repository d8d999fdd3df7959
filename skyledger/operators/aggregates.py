"""Aggregations: flights and tickets to routes, routes to city pairs, and summaries.

All group-bys use built-in aggregates that combine on the map side, so a route holding
a large share of the rows still sends one partial row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.text import symmetric_key
from skyledger.operators.quantiles import exact_quantiles

FLIGHT_MEANS = ("DISTANCE", "OCCUPANCY_RATE", "DEP_DELAY", "ARR_DELAY")
DIRECTION_KEYS = ("OP_CARRIER", "ORIGIN", "DESTINATION", "ORIGIN_CITY_NAME", "DEST_CITY_NAME")


def _known(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose group keys are all known: a missing key belongs to no group."""
    return df.dropna(subset=list(keys))


def _number(df: DataFrame, c: str) -> Column:
    """A measure; one that cleaning left as text counts where it is a number."""
    text = isinstance(df.schema[c].dataType, T.StringType)
    return F.col(c).try_cast("double") if text else F.col(c)


def _total(x: Column) -> Column:
    """Sum of a measure; that of a group without a known value is zero."""
    return F.coalesce(F.sum(x), F.lit(0))


def flights_by_direction(df: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Means per carrier and direction; TOTAL_FLIGHTS counts known tail numbers."""
    keys = [*DIRECTION_KEYS, *extra_keys]
    return (
        _known(df, keys)
        .groupBy(*keys)
        .agg(
            *[F.avg(_number(df, c)).alias(c) for c in FLIGHT_MEANS],
            F.count("TAIL_NUM").alias("TOTAL_FLIGHTS"),
        )
    )


def direction_sums(df: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Sums and counts that ``directions_of`` makes the means of, file by file or all at once."""
    measures = []
    for c in FLIGHT_MEANS:
        x = _number(df, c).cast("double")
        measures += [F.sum(x).alias(f"{c}_sum"), F.count(x).alias(f"{c}_count")]
    flights = F.count("TAIL_NUM").alias("TOTAL_FLIGHTS")
    return _known(df, DIRECTION_KEYS).groupBy(*DIRECTION_KEYS, *extra_keys).agg(*measures, flights)


def directions_of(sums: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """``flights_by_direction`` of everything that went into ``sums``, by any of its keys."""
    keys = [*DIRECTION_KEYS, *extra_keys]
    mean = lambda c: F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_count"))
    return _known(sums, keys).groupBy(*keys).agg(
        *[mean(c).alias(c) for c in FLIGHT_MEANS], F.sum("TOTAL_FLIGHTS").alias("TOTAL_FLIGHTS")
    )


def flights_by_route(
    directions: DataFrame, extra_keys: Sequence[str] = (), weighted: bool = False
) -> DataFrame:
    """Both directions under one symmetric route.

    The means are plain means of the direction means; ``weighted`` weighs them by flights.
    """
    routes = directions.select(
        *extra_keys,
        symmetric_key(F.col("ORIGIN"), F.col("DESTINATION")).alias("ROUTE_KEY"),
        "OP_CARRIER",
        symmetric_key(F.col("ORIGIN_CITY_NAME"), F.col("DEST_CITY_NAME"), " -> ").alias(
            "ROUTE_NAME_CITY"
        ),
        *FLIGHT_MEANS,
        "TOTAL_FLIGHTS",
    )
    flights = F.col("TOTAL_FLIGHTS")

    def mean(c: str) -> Column:
        if not weighted:
            return F.avg(c).alias(c)
        weight = F.when(F.col(c).isNotNull(), flights)
        return F.try_divide(F.sum(F.col(c) * flights), F.sum(weight)).alias(c)

    keys = ["ROUTE_KEY", "OP_CARRIER", "ROUTE_NAME_CITY", *extra_keys]
    return routes.groupBy(*keys).agg(
        *[mean(c) for c in FLIGHT_MEANS], F.sum("TOTAL_FLIGHTS").alias("TOTAL_FLIGHTS")
    )


def tickets_by_route(df: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Passengers and mean fare per symmetric route and carrier."""
    keys = ["ROUTE_KEY", "REPORTING_CARRIER", *extra_keys]
    known = _known(df, ["ORIGIN", "DESTINATION", "REPORTING_CARRIER", *extra_keys])
    return (
        known.withColumn("ROUTE_KEY", symmetric_key(F.col("ORIGIN"), F.col("DESTINATION")))
        .groupBy(*keys)
        .agg(
            _total(_number(df, "PASSENGERS")).alias("PASSENGERS"),
            F.avg(_number(df, "ITIN_FARE")).alias("ITIN_FARE"),
        )
    )


TICKET_KEYS = ("ROUTE_KEY", "REPORTING_CARRIER")


def ticket_sums(df: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Sums and counts that ``tickets_of`` makes passengers and fares of."""
    known = _known(df, ["ORIGIN", "DESTINATION", "REPORTING_CARRIER"])
    fare = _number(df, "ITIN_FARE").cast("double")
    return (
        known.withColumn("ROUTE_KEY", symmetric_key(F.col("ORIGIN"), F.col("DESTINATION")))
        .groupBy(*TICKET_KEYS, *extra_keys)
        .agg(
            _total(_number(df, "PASSENGERS")).alias("PASSENGERS"),
            F.sum(fare).alias("ITIN_FARE_sum"),
            F.count(fare).alias("ITIN_FARE_count"),
        )
    )


def tickets_of(sums: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """``tickets_by_route`` of everything that went into ``sums``, by any of its keys."""
    keys = [*TICKET_KEYS, *extra_keys]
    return _known(sums, keys).groupBy(*keys).agg(
        F.sum("PASSENGERS").alias("PASSENGERS"),
        F.try_divide(F.sum("ITIN_FARE_sum"), F.sum("ITIN_FARE_count")).alias("ITIN_FARE"),
    )


def route_summary(routes: DataFrame) -> DataFrame:
    """Per city pair: profit, mean total delay, passengers, mean round-trip distance."""
    delay = F.col("AVG_DEP_DELAY_MINUTES") + F.col("AVG_ARR_DELAY_MINUTES")
    return (
        _known(routes, ["ROUTE_NAME_CITY"])
        .groupBy("ROUTE_NAME_CITY")
        .agg(
            _total(F.col("PROFIT")).alias("PROFIT"),
            F.avg(delay).alias("AVG_TOTAL_DELAY_MINUTES"),
            _total(F.col("ESTIMATED_PASSENGERS")).alias("ESTIMATED_PASSENGERS"),
            F.avg("ROUND_TRIP_DISTANCE_MILES").alias("ROUND_TRIP_DISTANCE_MILES"),
        )
    )


def sum_by_route(routes: DataFrame, metric: str) -> DataFrame:
    """Sum of one metric per city pair."""
    known = _known(routes, ["ROUTE_NAME_CITY"])
    return known.groupBy("ROUTE_NAME_CITY").agg(_total(F.col(metric)).alias(metric))


def flights_per_route(routes: DataFrame) -> DataFrame:
    """Flights per city pair and airport pair."""
    keys = ["ROUTE_NAME_CITY", "AIRPORT_CODE_A", "AIRPORT_CODE_B"]
    return _known(routes, keys).groupBy(*keys).agg(F.sum("TOTAL_FLIGHTS").alias("TOTAL_FLIGHTS"))


def delay_metrics(routes: DataFrame) -> DataFrame:
    """Per city pair: mean total delay and summed delay cost."""
    delay = F.col("AVG_DEP_DELAY_MINUTES") + F.col("AVG_ARR_DELAY_MINUTES")
    return (
        _known(routes, ["ROUTE_NAME_CITY"])
        .groupBy("ROUTE_NAME_CITY")
        .agg(
            F.avg(delay).alias("AVG_TOTAL_DELAY_MINUTES"),
            _total(F.col("DELAY_COST")).alias("DELAY_COST"),
        )
    )


def one_row_per_column(
    df: DataFrame,
    measures: Mapping[str, Mapping[str, Column]],
    constants: Mapping[str, Mapping[str, float | None]] | None = None,
) -> DataFrame:
    """``{column: {measure: aggregate}}`` as one row per column, computed in one pass.

    ``constants`` adds figures per column that are already known.
    """
    aggregates, rows = [], []
    for i, (column, named) in enumerate(measures.items()):
        fields = [F.lit(column).alias("column_name")]
        for measure, aggregate in named.items():
            aggregates.append(aggregate.alias(f"{measure}_{i}"))
            fields.append(F.col(f"{measure}_{i}").alias(measure))
        for measure, value in (constants or {}).get(column, {}).items():
            fields.append(F.lit(value).cast("double").alias(measure))
        rows.append(F.struct(*fields))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def describe_numeric(
    df: DataFrame, columns: Sequence[str], exact: bool = True, cache: bool = False
) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per column.

    Takes several passes: stage a table that is dear to compute.
    """
    quartiles = exact_quantiles(
        df, {c: [0.25, 0.5, 0.75] for c in columns}, exact=exact, cache=cache
    )
    measures = {
        c: {
            "count": F.count(c),
            "mean": F.avg(c),
            "std": F.stddev_samp(c),
            "min": F.min(F.col(c).cast("double")),
            "max": F.max(F.col(c).cast("double")),
        }
        for c in columns
    }
    constants = {c: dict(zip(("p25", "p50", "p75"), quartiles[c])) for c in columns}
    names = ("column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")
    return one_row_per_column(df, measures, constants).select(*names)


def min_max(df: DataFrame, column: str) -> DataFrame:
    """Both ends of a column."""
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high"))


def profit_histogram(df: DataFrame, column: str = "PROFIT", bins: int = 50) -> DataFrame:
    """Equal-width bins over the whole range, the maximum in the last one.

    Also splits each bin into losses (below zero) and the rest; empty bins give no row.
    """
    ends = min_max(df, column).first()
    low, high = ends["low"], ends["high"]
    x = F.col(column)
    if low is None or low == high:
        width, number = 0.0, F.lit(0)
    else:
        width = (high - low) / bins
        number = F.least(F.floor((x - low) / width).cast("int"), F.lit(bins - 1))
    return (
        df.where(x.isNotNull())
        .groupBy(number.alias("bin"))
        .agg(
            F.count("*").alias("row_count"),
            F.count_if(x < 0).alias("loss_count"),
            F.count_if(x >= 0).alias("profit_count"),
        )
        .withColumns(
            {
                "bin_low": F.lit(low).cast("double") + F.col("bin") * width,
                "bin_high": F.lit(low).cast("double") + (F.col("bin") + 1) * width,
            }
        )
    )


def box_stats(
    df: DataFrame, columns: Sequence[str], factor: float = 1.5, cache: bool = False
) -> DataFrame:
    """Quartiles, whisker ends and number of points beyond them, one row per column."""
    quartiles = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns}, cache=cache)

    measures = {}
    for c in columns:
        x = F.col(c).cast("double")
        q1, _, q3 = quartiles[c]
        reach = None if q1 is None else factor * (q3 - q1)
        low = F.lit(None if q1 is None else q1 - reach).cast("double")
        high = F.lit(None if q1 is None else q3 + reach).cast("double")
        inside = F.when((x >= low) & (x <= high), x)
        measures[c] = {
            "whisker_low": F.min(inside),
            "whisker_high": F.max(inside),
            "outlier_count": F.count_if((x < low) | (x > high)),
        }
    constants = {c: dict(zip(("q1", "median", "q3"), quartiles[c])) for c in columns}
    return one_row_per_column(df, measures, constants)
