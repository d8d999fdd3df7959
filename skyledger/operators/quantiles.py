"""Exact quantiles of whole columns in bounded memory.

The built-in exact percentile keeps every distinct value of a column in one
aggregation buffer. Here the wanted ranks are narrowed down instead. The pass that finds
the ends of a column also takes an equal-depth summary of it: ``STEPS`` points between
which about equally many values lie, from a sketch of one row in ``SAMPLE``. It brackets
each rank, so that the number of passes does not depend on how the values are spread, and
it is planned with as follows:

* a column of at most ``finish_rows`` values is counted value by value;
* in a longer one, a rank is looked for between the points around it, value by value if
  they are one point or few rows lie there, in equal-width bins else;
* without a summary (ends that someone else found) the whole column goes into bins. Only
  if the bin of a rank still holds more than ``finish_rows`` rows is that column sketched.

A pass counts the values below, inside and above the bracket, those inside into cells
(combined on the map side, so a hot value costs nothing), and the cell that holds the rank
becomes the next interval: a summary that missed costs a pass, never the answer. Only one
row per wanted rank ever reaches the driver, and no task sees more than about ``bins`` or
``finish_rows`` groups of one interval.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

BINS = 4096
FINISH_ROWS = 250_000
#: Cells of the equal-depth summary, and one in how many rows it is taken from.
STEPS = 64
SAMPLE = 16
ACCURACY = 1_000


@dataclass
class _Rank:
    column: str
    rank: int
    low: float
    high: float
    below: int
    inside: int
    bracket: tuple[float, float, int] | None = None  # its ends, and how many rows it may hold

    @property
    def interval(self) -> tuple:
        return self.column, self.low, self.high, self.below, self.inside

    @property
    def settled(self) -> bool:
        return self.low == self.high


def _number(column: str) -> Column:
    """The column as a double; NaN is a missing value."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def _bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Number of the equal-width bin; ``low`` is in the first, ``high`` in the last one.

    Halves keep the width from overflowing, and infinities count as the largest doubles.
    """
    biggest = 1.7976931348623157e308
    low, high = max(low, -biggest), min(high, biggest)
    width = high / 2 - low / 2
    last = F.when(value >= high, bins - 1)
    if width == 0:
        return last.otherwise(0)
    share = (F.greatest(value, F.lit(low)) / 2 - low / 2) / width
    return last.otherwise(F.least(F.floor(share * bins), F.lit(bins - 1)))


def _stretches(ranks: list[_Rank]) -> list[tuple[float, float, int]]:
    """The brackets of an interval's ranks in order, those that overlap as one."""
    out: list[tuple[float, float, int]] = []
    for start, end, held in sorted({r.bracket or (r.low, r.high, r.inside) for r in ranks}):
        if out and start <= out[-1][1]:
            first, last, so_far = out.pop()
            start, end, held = first, max(last, end), so_far + held
        out.append((start, end, held))
    return out


def _cell(i: int, ranks: list[_Rank], bins: int, finish_rows: int) -> Column:
    """Where a value of the ranks' interval is counted: in which stretch, by bin or by value, or
    between which two. Cells are in the order of their values."""
    value, none = F.col(ranks[0].column), F.lit(None).cast("double")
    stretches = _stretches(ranks)
    after = 2 * len(stretches) * bins
    cell, point = F.lit(after), none
    for n, (start, end, held) in reversed(list(enumerate(stretches))):
        by_value = held * len(stretches) <= finish_rows or start == end
        inside, before = value <= end, value < start
        bin_ = F.lit(0) if by_value else _bin(value, start, end, bins)
        cell = F.when(before, 2 * n * bins).when(inside, bin_ + (2 * n + 1) * bins).otherwise(cell)
        point = F.when(before, none).when(inside, value if by_value else none).otherwise(point)
    return F.when(
        value.between(ranks[0].low, ranks[0].high),
        F.struct(
            F.lit(i).alias("interval"),
            cell.cast("long").alias("bin"),
            point.alias("point"),
            value.alias("value"),
        ),
    )


def _advance(values: DataFrame, ranks: list[_Rank], bins: int, finish_rows: int) -> None:
    """One pass over ``values``: shrink the interval of every unsettled rank.

    A value is counted once for its column, however many ranks are looked for there.
    """
    open_ranks = [r for r in ranks if not r.settled]
    intervals: dict[tuple, list[_Rank]] = {}
    for r in open_ranks:
        intervals.setdefault(r.interval, []).append(r)
    number = {interval: i for i, interval in enumerate(intervals)}
    cells = [_cell(i, held, bins, finish_rows) for i, held in enumerate(intervals.values())]
    counted = (
        values.select(F.inline(F.array(*cells)))
        .where("interval is not null")
        .groupBy("interval", "bin", "point")
        .agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
    running = F.sum("n").over(Window.partitionBy("interval").orderBy("bin", "point"))
    places = [(number[r.interval], r.rank - r.below) for r in open_ranks]
    upto, n = F.col("upto"), F.col("n")
    wanted = reduce(
        lambda x, y: x | y,
        [(F.col("interval") == i) & (upto > k) & (upto - n <= k) for i, k in set(places)],
    )
    hits = counted.withColumn("upto", running).where(wanted).drop("bin", "point").collect()
    for r, (i, k) in zip(open_ranks, places):
        hit = next(h for h in hits if h["interval"] == i and h["upto"] - h["n"] <= k < h["upto"])
        r.below += hit["upto"] - hit["n"]
        r.low, r.high, r.inside, r.bracket = hit["low"], hit["high"], hit["n"], None


def _bracketed(values: DataFrame, ranks: list[_Rank], accuracy: int) -> None:
    """Brackets for all ranks from one pass of a sketch, four of its errors wide.

    Ranks that passes have narrowed down are looked for among the values left to them.
    """
    slack = 2 / accuracy
    asked: dict[tuple, list[float]] = {}
    for r in ranks:
        p = (r.rank - r.below) / max(r.inside - 1, 1)
        asked.setdefault((r.column, r.low, r.high), []).extend(
            (max(0.0, p - slack), min(1.0, p + slack))
        )
    sketches = [
        F.percentile_approx(F.when(F.col(c).between(low, high), F.col(c)), p, accuracy).alias(str(i))
        for i, ((c, low, high), p) in enumerate(asked.items())
    ]
    row = values.agg(*sketches).first()
    ends = {place: iter(row[i]) for i, place in enumerate(asked)}
    for r in ranks:
        place = ends[r.column, r.low, r.high]
        r.bracket = next(place), next(place), math.ceil(6 * r.inside / accuracy)


@dataclass(frozen=True)
class Extent:
    """Known values of a column, its ends, and points of equal depth between them."""

    count: int
    low: float | None
    high: float | None
    depth: tuple[float, ...] | None = None

    def bracket(self, rank: int) -> tuple[float, float, int] | None:
        """Where a rank probably lies, and how many rows that may hold: a step on either side."""
        if not self.depth or len(self.depth) < 4:
            return None
        steps = len(self.depth) - 1
        at = rank / max(self.count - 1, 1) * steps
        first, last = max(0, math.floor(at) - 1), min(steps, math.ceil(at) + 1)
        start = self.low if first == 0 else self.depth[first]
        end = self.high if last == steps else self.depth[last]
        return start, end, math.ceil(self.count * (last - first + 1) / steps)

    def filled(self, value: float | None, times: int) -> Extent:
        """The extent once ``times`` more rows hold ``value``, which lies between the ends."""
        if not times or value is None or self.low is None:
            return self
        count = self.count + times
        if not self.depth:
            return Extent(count, self.low, self.high)
        steps = len(self.depth) - 1
        at = bisect_left(self.depth, value)
        size, extra = self.count / steps, times
        depth = []
        for i in range(steps + 1):  # rank i / steps of the values and the fills between them
            place = i * count / steps
            if place <= at * size:
                depth.append(self.depth[min(round(place / size), steps)])
            elif place <= at * size + extra:
                depth.append(value)
            else:
                depth.append(self.depth[min(round((place - extra) / size), steps)])
        return Extent(count, self.low, self.high, tuple(depth))

    def distances(self, center: float) -> Extent:
        """Of the distances from ``center``: the farther end bounds them."""
        far = max(self.high - center, center - self.low)
        depth = tuple(sorted(abs(x - center) for x in self.depth)) if self.depth else None
        return Extent(self.count, 0.0, far, depth)


def extent_measures(columns: Sequence[str], chosen: Column) -> list[Column]:
    """Aggregates that ``read_extents`` picks up from the result row.

    ``chosen`` tells the rows, one in ``SAMPLE``, that the summaries are taken from.
    """
    measures = []
    points = [i / STEPS for i in range(STEPS + 1)]
    for c in columns:
        x = _number(c)
        measures += [
            F.count(x).alias(f"{c}:n"),
            F.min(x).alias(f"{c}:low"),
            F.max(x).alias(f"{c}:high"),
            F.percentile_approx(F.when(chosen, x), points, ACCURACY).alias(f"{c}:depth"),
        ]
    return measures


def some_rows(df: DataFrame) -> Column:
    """About one row in ``SAMPLE``, by its values: what a deterministic measure can choose by."""
    return F.pmod(F.xxhash64(*df.columns), F.lit(SAMPLE)) == 0


def read_extents(row: Mapping[str, object] | Row, columns: Sequence[str]) -> dict[str, Extent]:
    return {
        c: Extent(
            row[f"{c}:n"], row[f"{c}:low"], row[f"{c}:high"], tuple(row[f"{c}:depth"] or ()) or None
        )
        for c in columns
    }


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    *,
    extents: Mapping[str, Extent] | None = None,
    exact: bool = True,
    accuracy: int = 10_000,
    cache: bool = False,
    bins: int = BINS,
    finish_rows: int = FINISH_ROWS,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, nulls ignored, all columns at once.

    Makes a few passes over ``df``: stage it first, or pass ``cache=True``, when recomputing
    it is dear, and pass ``extents`` when another pass has found them already.
    ``exact=False`` takes one pass and answers within ``1 / accuracy`` of the rank.
    """
    if not wanted:
        return {}
    columns = list(wanted)
    values = df.select(*[_number(c).alias(c) for c in columns])
    if not exact:
        row = values.agg(
            *[
                F.percentile_approx(c, [float(p) for p in wanted[c]], accuracy).alias(c)
                for c in columns
            ]
        ).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(wanted[c]) for c in columns}

    if cache:
        values = values.persist()
    try:
        if extents is None:
            drawn = values.withColumn("__draw", F.rand(SAMPLE))
            measures = extent_measures(columns, F.col("__draw") * SAMPLE < 1)
            extents = read_extents(drawn.agg(*measures).first(), columns)
        ranks: dict[tuple[str, int], _Rank] = {}
        spots: dict[str, list[tuple[int, int, float]]] = {}
        for c in columns:
            extent = extents[c]
            n = extent.count
            spots[c] = []
            for p in wanted[c] if n else ():
                position = p * (n - 1)
                lower = math.floor(position)
                upper = math.ceil(position)
                spots[c].append((lower, upper, position - lower))
                for k in (lower, upper):
                    rank = _Rank(c, k, extent.low, extent.high, 0, n)
                    if n > finish_rows:
                        rank.bracket = extent.bracket(k)
                    ranks.setdefault((c, k), rank)
        sketched: set[str] = set()
        while any(not r.settled for r in ranks.values()):
            _advance(values, list(ranks.values()), bins, finish_rows)
            wide = [
                r for r in ranks.values()
                if not r.settled and r.inside > finish_rows and r.column not in sketched
            ]
            if wide:
                _bracketed(values, wide, accuracy)
                sketched |= {r.column for r in wide}
    finally:
        if cache:
            values.unpersist()

    result: dict[str, list[float | None]] = {}
    for c in columns:
        found = []
        for lower, upper, share in spots[c]:
            a, b = ranks[c, lower].low, ranks[c, upper].low
            found.append(a if share == 0 or a == b else a + (b - a) * share)
        result[c] = found or [None] * len(wanted[c])
    return result


def exact_medians(df: DataFrame, columns: Sequence[str], **options) -> dict[str, float | None]:
    """Median per column."""
    return {c: q[0] for c, q in exact_quantiles(df, {c: [0.5] for c in columns}, **options).items()}
