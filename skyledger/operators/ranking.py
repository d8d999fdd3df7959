"""Filters and rankings on the route table.

Nulls rank last in both directions, and ties are broken by route and carrier.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.operators.kpis import add_cost_shares
from skyledger.operators.quantiles import exact_medians
from skyledger.params import DEFAULT_SWEET_SPOT, LARGE, MEDIUM, SweetSpot

TIE_BREAK = ("ROUTE", "CARRIER", "ROUTE_NAME_CITY", "AIRPORT_CODE_A", "AIRPORT_CODE_B")

# The order in which grouped routes are stored.
STORED_ORDER = ("ROUTE", "CARRIER")


def descending(*columns: str) -> list[Column]:
    return [F.desc_nulls_last(c) for c in columns]


def ascending(*columns: str) -> list[Column]:
    return [F.asc_nulls_last(c) for c in columns]


def medium_large(routes: DataFrame) -> DataFrame:
    """Routes between a medium and a large airport, either way round."""
    a, b = F.col("AIRPORT_A_SIZE"), F.col("AIRPORT_B_SIZE")
    return routes.where(((a == MEDIUM) & (b == LARGE)) | ((a == LARGE) & (b == MEDIUM)))


def positive(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with every named amount above zero."""
    for c in columns:
        df = df.where(F.col(c) > 0)
    return df


def sweet_spot(summary: DataFrame, limits: SweetSpot = DEFAULT_SWEET_SPOT) -> DataFrame:
    """City pairs that are profitable, punctual and in demand at once."""
    return summary.where(
        (F.col("PROFIT") >= limits.min_profit)
        & (F.col("AVG_TOTAL_DELAY_MINUTES") <= limits.max_delay)
        & (F.col("ESTIMATED_PASSENGERS") >= limits.min_passengers)
    )


def named_routes(routes: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of the named city pairs; a long list becomes a semi join."""
    if len(names) <= 100:
        return routes.where(F.col("ROUTE_NAME_CITY").isin(*names))
    wanted = routes.sparkSession.createDataFrame([(n,) for n in names], "ROUTE_NAME_CITY string")
    return routes.join(wanted, "ROUTE_NAME_CITY", "left_semi")


def balanced_cost(routes: DataFrame, limit: float = 0.7, cache: bool = False) -> DataFrame:
    """No cost above ``limit`` of the total, and a delay share of at most the median.

    The median is exact and takes a few passes: stage ``routes`` when it is dear to compute.
    """
    shares = add_cost_shares(routes, percent=False)
    median = exact_medians(shares, ["DELAY_COST_PCT"], cache=cache)["DELAY_COST_PCT"]
    return shares.where(
        (F.col("MILEAGE_COST_PCT") <= limit)
        & (F.col("AIRPORT_FEES_PCT") <= limit)
        & (F.col("DELAY_COST_PCT") <= limit)
        & (F.col("DELAY_COST_PCT") <= F.lit(median).cast("double"))
    )


def top_k(
    df: DataFrame, order: Sequence[Column], n: int, columns: Sequence[str] | None = None
) -> DataFrame:
    """The first ``n`` rows; each task keeps only its own best ``n``."""
    ties = [F.asc_nulls_last(c) for c in TIE_BREAK if c in df.columns]
    ranked = df.orderBy(*order, *ties).limit(n)
    return ranked.select(*columns) if columns else ranked


@dataclass(frozen=True)
class Ranking:
    """The ``n`` rows of largest ``metrics``, compared one after the other; ``least`` turns the
    order round, and only rows that meet ``where`` take part."""

    metrics: tuple[str, ...]
    n: int = 10
    least: bool = False
    where: Column | None = None


def top_each(df: DataFrame, rankings: Mapping[str, Ranking]) -> DataFrame:
    """Many rankings of one table in one pass: ``RANKING``, ``POSITION`` from 1, and the row.

    Each gives the rows that ``top_k`` gives. A row stands once for each ranking inside its task
    only: a task sends at most as many rows of a ranking as the largest ``n``. Nulls rank last.
    """
    if not rankings:
        raise ValueError("name one ranking at least")
    taken = [c for c in ("RANKING", "POSITION") if c in df.columns]
    if taken:
        raise ValueError(f"columns are in the table already: {taken}")
    entered = [
        F.lit(name) if r.where is None else F.when(r.where, F.lit(name))
        for name, r in rankings.items()
    ]
    rows = df.select("*", F.explode(F.array_compact(F.array(*entered))).alias("RANKING"))
    order, inside = [], []
    for name, r in rankings.items():
        own = F.col("RANKING") == name
        sort = F.asc_nulls_last if r.least else F.desc_nulls_last
        order += [sort(F.when(own, F.col(c))) for c in r.metrics]
        inside.append(own & (F.col("POSITION") <= r.n))
    order += [F.asc_nulls_last(c) for c in TIE_BREAK if c in df.columns]
    ranked = rows.withColumn(
        "POSITION", F.row_number().over(Window.partitionBy("RANKING").orderBy(*order))
    )
    most = max(r.n for r in rankings.values())
    best = ranked.where(F.col("POSITION") <= most).where(reduce(lambda x, y: x | y, inside))
    return best.select("RANKING", "POSITION", *df.columns)


def best_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each group; each task sends at most one candidate per group."""
    ties = [F.asc_nulls_last(c) for c in TIE_BREAK if c in df.columns]
    first = Window.partitionBy(*group).orderBy(*order, *ties)
    return df.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def first_stored(df: DataFrame, group: Sequence[str] = ("ROUTE_NAME_CITY",)) -> DataFrame:
    """First row of each group in stored order."""
    return best_per_group(df, group, [F.col(c) for c in STORED_ORDER])
