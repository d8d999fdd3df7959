"""Equi-joins, and the join of routes with tickets and airports.

No broadcast is forced: Spark broadcasts a side whose size it knows, from file
statistics or at run time, to be under ``spark.sql.autoBroadcastJoinThreshold``, and
otherwise sorts and merges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.text import route_end

HOWS = ("inner", "left", "right", "outer")
AIRPORT_ATTRIBUTES = ("TYPE", "NAME", "ELEVATION_FT", "MUNICIPALITY", "COORDINATES")

#: Rows of one key that a task may have to sort; a key with more is dealt to several.
HOT_ROWS = 1_000_000
#: Keys looked at on each side, the most frequent ones.
MOST_KEYS = 1_000


def join_on(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str],
    how: str = "inner",
    null_safe: bool = False,
    hot_keys: bool = True,
) -> DataFrame:
    """Join on differently named keys; both key columns are kept.

    ``null_safe`` lets missing keys match each other. A sketch of each side finds the keys with
    more than ``HOT_ROWS`` rows. The rows of such a key are dealt to as many shares as it takes,
    and those of the other side go to every share, so no task sorts a whole hot key; the adaptive
    skew join splits what still is uneven. Neither splits the side that fills in a left or right
    join, so those and the full one run as an inner join plus the rows without a partner, and
    rows with a missing key, which have none, are not shuffled. ``hot_keys=False`` spares the
    sketches and the second shuffle where no key holds a large share of the rows.
    """
    if len(left_keys) != len(right_keys) or not left_keys:
        raise ValueError("left_keys and right_keys must be non-empty and equally long")
    if how not in HOWS:
        raise ValueError(f"how must be one of {HOWS}, got {how!r}")
    if not hot_keys:
        return left.join(right, _equal(left, left_keys, right, right_keys, null_safe), how)
    on_left, on_right = _shares(left, left_keys, right, right_keys, null_safe)
    a = _to_all(_dealt(left, left_keys, on_left, "_share_a"), left_keys, on_right, "_share_b")
    b = _dealt(_to_all(right, right_keys, on_left, "_share_c"), right_keys, on_right, "_share_d")
    equal = _equal(a, left_keys, b, right_keys, null_safe)
    if on_left:
        equal &= a["_share_a"] == b["_share_c"]
    if on_right:
        equal &= a["_share_b"] == b["_share_d"]
    joined = a.join(b, equal, "inner")
    if on_left or on_right:
        joined = joined.drop("_share_a", "_share_b", "_share_c", "_share_d")
    if how in ("left", "outer"):
        alone = _without_partner(left, left_keys, right, right_keys, null_safe, on_left)
        joined = joined.unionAll(alone.select("*", *_nothing(right)))
    if how in ("right", "outer"):
        alone = _without_partner(right, right_keys, left, left_keys, null_safe, on_right)
        joined = joined.unionAll(alone.select(*_nothing(left), "*"))
    return joined


def _equal(
    left: DataFrame, left_keys: Sequence[str], right: DataFrame, right_keys: Sequence[str], null_safe: bool
) -> Column:
    return reduce(
        lambda x, y: x & y,
        [
            left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b]
            for a, b in zip(left_keys, right_keys)
        ],
    )


def _known(side: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [side[k].isNotNull() for k in keys])


def _key_hash(side: DataFrame, keys: Sequence[str]) -> Column:
    """The same number for keys that are equal, whatever the width of their integers."""
    whole = (T.ByteType, T.ShortType, T.IntegerType)
    wide = [side[k].cast("long") if isinstance(side.schema[k].dataType, whole) else side[k] for k in keys]
    return F.xxhash64(*wide)


def _shares(
    left: DataFrame, left_keys: Sequence[str], right: DataFrame, right_keys: Sequence[str], null_safe: bool
) -> tuple[dict[int, int], dict[int, int]]:
    """The hashes of the hot keys of both sides, and to how many shares each is dealt.

    Keys whose equal values may differ in their hash, and streams, are left alone. A count that
    the sketch puts too high or low makes shares smaller or larger, no row is lost by it.
    """
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    plain = (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)
    for a, b in zip(left_keys, right_keys):
        x, y = left.schema[a].dataType, right.schema[b].dataType
        same = x == y and (isinstance(x, plain) or x == T.StringType())
        if not (same or isinstance(x, whole) and isinstance(y, whole)):
            return {}, {}
    if left.isStreaming or right.isStreaming:
        return {}, {}

    def frequent(side: DataFrame, keys: Sequence[str]) -> dict[int, int]:
        rows = side if null_safe else side.where(_known(side, keys))
        hashes = rows.select(_key_hash(side, keys).alias("h"))
        found = hashes.agg(F.expr(f"approx_top_k(h, {MOST_KEYS}, {10 * MOST_KEYS})").alias("top")).first()
        return {r["item"]: ceil(r["count"] / HOT_ROWS) for r in found["top"] or () if r["count"] > HOT_ROWS}

    return frequent(left, left_keys), frequent(right, right_keys)


def _ways(side: DataFrame, keys: Sequence[str], shares: Mapping[int, int]) -> Column:
    hot = F.create_map(*[F.lit(v).cast("long") for pair in shares.items() for v in pair])
    return F.coalesce(F.try_element_at(hot, _key_hash(side, keys)), F.lit(1).cast("long"))


def _dealt(side: DataFrame, keys: Sequence[str], shares: Mapping[int, int], name: str) -> DataFrame:
    """Every row in one share of its key, drawn at random: equal rows spread as well."""
    if not shares:
        return side
    return side.withColumn(name, F.floor(F.rand(0) * _ways(side, keys, shares)))


def _to_all(side: DataFrame, keys: Sequence[str], shares: Mapping[int, int], name: str) -> DataFrame:
    """Every row once for each share of its key."""
    if not shares:
        return side
    last = _ways(side, keys, shares) - 1
    return side.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), last)))


def _without_partner(
    side: DataFrame,
    keys: Sequence[str],
    other: DataFrame,
    other_keys: Sequence[str],
    null_safe: bool,
    shares: Mapping[int, int],
) -> DataFrame:
    """Rows of ``side`` that match none of ``other``, whose keys are reduced to distinct ones."""
    partners = _to_all(other.select(*other_keys).distinct(), other_keys, shares, "_share_b")
    rows = side if null_safe else side.where(_known(side, keys))
    dealt = _dealt(rows, keys, shares, "_share_a")
    equal = _equal(dealt, keys, partners, other_keys, null_safe)
    if shares:
        equal &= dealt["_share_a"] == partners["_share_b"]
    alone = dealt.join(partners, equal, "left_anti").drop("_share_a")
    return alone if null_safe else alone.unionAll(side.where(~_known(side, keys)))


def _nothing(side: DataFrame) -> list[Column]:
    return [F.lit(None).cast(f.dataType).alias(f.name) for f in side.schema.fields]


def join_on_key(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    null_safe: bool = False,
    hot_keys: bool = True,
) -> DataFrame:
    """Join on one common key, given once; other names must differ. Options as in ``join_on``."""
    overlap = sorted((set(left.columns) & set(right.columns)) - {key})
    if overlap:
        raise ValueError(f"columns overlap: {overlap}")
    if how == "inner" and not null_safe and not hot_keys:
        return left.join(right, key)
    other = right.withColumnRenamed(key, "_right_key")
    joined = join_on(left, other, [key], ["_right_key"], how, null_safe, hot_keys)
    if how == "inner" and not null_safe:
        return joined.select(key, *[c for c in joined.columns if c not in (key, "_right_key")])
    rest = [c for c in joined.columns if c not in (key, "_right_key")]
    return joined.select(F.coalesce(key, "_right_key").alias(key), *rest)


def join_flights_tickets(
    flights: DataFrame, tickets: DataFrame, extra_keys: Sequence[str] = ()
) -> DataFrame:
    """Grouped flights with grouped tickets of the same route and carrier."""
    joined = join_on(
        flights.alias("f"),
        tickets.alias("t"),
        ["ROUTE_KEY", "OP_CARRIER", *extra_keys],
        ["ROUTE_KEY", "REPORTING_CARRIER", *extra_keys],
        hot_keys=False,
    )
    doubled = {"ROUTE_KEY", *extra_keys}
    return joined.select("f.*", *[f"t.{c}" for c in tickets.columns if c not in doubled])


def split_route(df: DataFrame, strict: bool = False) -> DataFrame:
    """AIRPORT_A and AIRPORT_B out of ROUTE_KEY."""
    key = F.col("ROUTE_KEY")
    return df.withColumns(
        {f"AIRPORT_{s}": route_end(key, s, strict) for s in ("A", "B")}
    )


def add_airport(df: DataFrame, airports: DataFrame, side: str) -> DataFrame:
    """Airport attributes of one side, prefixed with its role; unmatched airports stay."""
    role = f"AIRPORT_{side}"
    attributes = airports.select(
        F.col("IATA_CODE").alias(role),
        *[F.col(c).alias(f"{role}_{c}") for c in AIRPORT_ATTRIBUTES],
    )
    return df.join(attributes, role, "left")


def enrich_routes(
    flights: DataFrame,
    tickets: DataFrame,
    airports: DataFrame,
    extra_keys: Sequence[str] = (),
    strict: bool = False,
) -> DataFrame:
    """Flights with tickets, then the attributes of both airports."""
    routes = join_flights_tickets(flights, tickets, extra_keys).transform(split_route, strict)
    return routes.transform(add_airport, airports, "A").transform(add_airport, airports, "B")
