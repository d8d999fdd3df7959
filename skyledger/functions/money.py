"""Arithmetic used by the route model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyledger.params import DEFAULT_PARAMS, MEDIUM, RouteParams


def round_half_even(value: Column, scale: int = 2) -> Column:
    """Scale, round to the even neighbour, scale back - binary floats, like array libraries do.

    ``bround`` rounds the printed decimal instead and goes through BigDecimal per row.
    """
    factor = float(10**scale)
    return F.rint(value * factor) / factor if scale else F.rint(value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient; null (never infinite) when the denominator is zero."""
    return F.try_divide(numerator, denominator)


def airport_fee(size: Column, params: RouteParams = DEFAULT_PARAMS) -> Column:
    """Landing fee; anything not known to be medium, a missing size too, pays the other fee."""
    return F.when(size == MEDIUM, params.medium_airport_fee).otherwise(params.other_airport_fee)


def excess_delay_cost(minutes: Column, params: RouteParams = DEFAULT_PARAMS) -> Column:
    """Cost of the minutes beyond the free ones; a missing delay stays missing."""
    excess = minutes - params.free_delay_minutes
    return (
        F.when(excess > 0, excess * params.delay_cost_per_minute)
        .when(minutes.isNotNull(), F.lit(0.0))
    )
