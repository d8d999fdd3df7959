"""Outlier flags, summaries and capping by the median absolute deviation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.money import ratio, round_half_even
from skyledger.operators.aggregates import one_row_per_column
from skyledger.operators.quantiles import Extent, exact_medians, exact_quantiles

METHODS = ("zscore", "iqr")


def _outside(low: float | None, x: Column, high: float | None) -> Column:
    return F.coalesce((x < F.lit(low).cast("double")) | (x > F.lit(high).cast("double")), F.lit(False))


def outlier_tests(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "zscore",
    z: float = 3.0,
    factor: float = 1.5,
    quartiles: Mapping[str, tuple[float | None, float | None]] | None = None,
    exact: bool = True,
    cache: bool = False,
) -> dict[str, Column]:
    """A boolean test per column; a null is never an outlier.

    ``zscore``: more than ``z`` population deviations from the mean.
    ``iqr``: strictly beyond the quartiles by more than ``factor`` times their distance;
    ``quartiles`` spares the passes that find them.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")
    if method == "zscore":
        row = df.agg(
            *[F.avg(c).alias(f"mean_{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(c).alias(f"std_{i}") for i, c in enumerate(columns)],
        ).first()
        tests = {}
        for i, c in enumerate(columns):
            mean, std = F.lit(row[f"mean_{i}"]).cast("double"), F.lit(row[f"std_{i}"]).cast("double")
            score = F.abs(F.try_divide(F.col(c).cast("double") - mean, std))
            tests[c] = F.coalesce(score > z, F.lit(False))
        return tests
    if quartiles is None:
        quartiles = exact_quantiles(
            df, {c: [0.25, 0.75] for c in columns}, exact=exact, cache=cache
        )
    tests = {}
    for c in columns:
        q1, q3 = quartiles[c]
        low, high = (None, None) if q1 is None else (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
        tests[c] = _outside(low, F.col(c).cast("double"), high)
    return tests


def outlier_flags(df: DataFrame, columns: Sequence[str], method: str = "zscore", **options) -> DataFrame:
    """Adds ``<c>_is_outlier`` per column."""
    tests = outlier_tests(df, columns, method, **options)
    return df.withColumns({f"{c}_is_outlier": test for c, test in tests.items()})


def outlier_summary(
    df: DataFrame, columns: Sequence[str], method: str = "zscore", **options
) -> DataFrame:
    """Skewness, excess kurtosis (both of the population) and outlier count per column.

    A column without spread has no skewness: null.
    """
    tests = outlier_tests(df, columns, method, **options)
    return one_row_per_column(
        df,
        {
            c: {
                "skewness": F.skewness(c),
                "kurtosis": F.kurtosis(c),
                "outlier_count": F.count_if(tests[c]),
            }
            for c in columns
        },
    ).withColumns(
        {m: round_half_even(F.col(m), 2) for m in ("skewness", "kurtosis")}
    )


@dataclass(frozen=True)
class MadBounds:
    median: float
    mad: float
    k: float

    @property
    def low(self) -> float:
        return self.median - self.k * self.mad

    @property
    def high(self) -> float:
        return self.median + self.k * self.mad


def mad_bounds(
    df: DataFrame,
    columns: Sequence[str],
    k: float = 3.0,
    medians: Mapping[str, float | None] | None = None,
    exact: bool = True,
    cache: bool = False,
    extents: Mapping[str, Extent] | None = None,
) -> dict[str, MadBounds]:
    """Median and unscaled median absolute deviation, of all columns together.

    Nulls are left out of both; a column of nulls gets no bounds. ``medians`` spares the
    passes that find them, ``extents`` of the columns the one that finds the ends of the
    distances: the farther end bounds them.
    """
    if medians is None:
        medians = exact_medians(df, columns, exact=exact, cache=cache)
    known = [c for c in columns if medians[c] is not None]
    distances = df.select(
        *[F.abs(F.col(c).cast("double") - F.lit(medians[c])).alias(c) for c in known]
    )
    ends = None
    if extents is not None:
        ends = {c: e.distances(medians[c]) for c, e in extents.items() if c in known}
    mads = exact_medians(distances, known, exact=exact, cache=cache, extents=ends)
    return {c: MadBounds(medians[c], mads[c], k) for c in known}


def _clipped(c: str, b: MadBounds) -> Column:
    x = F.col(c).cast("double")
    return F.when(x < b.low, b.low).when(x > b.high, b.high).otherwise(x)


def clip_columns(df: DataFrame, bounds: Mapping[str, MadBounds]) -> DataFrame:
    """Values beyond the bounds moved onto them; nulls stay null."""
    return df.withColumns({c: _clipped(c, b) for c, b in bounds.items()})


def cap_mad(df: DataFrame, columns: Sequence[str], k: float = 3.0, **options) -> DataFrame:
    """Clip to median ± k · MAD. A MAD of zero collapses the column onto its median."""
    return clip_columns(df, mad_bounds(df, columns, k, **options))


def mad_report(df: DataFrame, bounds: Mapping[str, MadBounds]) -> DataFrame:
    """What capping with ``bounds`` changes, one row per column."""
    measures, constants = {}, {}
    for c, b in bounds.items():
        moved = F.abs(F.col(c).cast("double") - _clipped(c, b)) > 1e-8
        measures[c] = {"capped_rows": F.count_if(moved), "row_count": F.count(F.lit(1))}
        constants[c] = {"median": b.median, "mad": b.mad, "lower": b.low, "upper": b.high}
    report = one_row_per_column(df, measures, constants)
    return report.withColumns(
        {
            "capped_pct": ratio(F.col("capped_rows"), F.col("row_count")) * 100,
            "collapsed": F.col("mad") == 0,
        }
    )


def cap_mad_report(
    df: DataFrame, columns: Sequence[str], k: float = 3.0, **options
) -> tuple[DataFrame, DataFrame]:
    """The capped table and its report."""
    bounds = mad_bounds(df, columns, k, **options)
    return clip_columns(df, bounds), mad_report(df, bounds)
