"""Flights, tickets and airports derived from the driver's tables.

The tables hold no airline data and no dirt, so both are derived by fixed rules; every
row of ``lineitem`` takes part. Measures are multiples of small powers of two, so sums are
exact and results do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts a numeric column may hold, in the order they are dealt out.
EDGE_NUMBERS = (
    "Thirty Five", "THIRTY  five", "12", "12.5", "-5.0", "-5", " 12",
    "8.9abc", "Two Hundred", "12 Five", "thirteen", "Thirty-Five", "", None,
)

# Words dealt out by line number (1 to 7).
EDGE_WORDS = ("Zero", "seven", "TEN", "Ninety", "hundred", "eleven", "Thousand")


# The driver's schemas, declared so that no footer is read to find them.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _letter(key: str) -> Column:
    return F.char(F.col(key) + 65)


def _code(key: str) -> Column:
    return F.concat(_letter(key), F.lit("AA"))


def _city(key: str) -> Column:
    return F.concat(F.lit("City "), _letter(key))


def _legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items between a customer's and a supplier's nation.

    Orders meet customers before the line items, so the largest table is joined (and, once
    the others are too large to broadcast, shuffled) twice and not three times. Texts are
    formed on the small sides.
    """
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", _code("c_nationkey").alias("c_code"), _city("c_nationkey").alias("c_city")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_nationkey", _code("s_nationkey").alias("s_code"), _city("s_nationkey").alias("s_city"),
        F.concat(F.lit("N"), F.col("s_suppkey").cast("string")).alias("s_tail"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return (
        table(spark, sf_dir, "lineitem")
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    )


def _carrier() -> Column:
    return F.concat("l_returnflag", "l_linestatus")


def _flight_columns() -> list[Column]:
    gap = F.abs(F.col("c_nationkey") - F.col("s_nationkey"))
    late = F.col("l_quantity") - 25 + gap * 3
    quantity, line = F.col("l_quantity"), F.col("l_linenumber")
    percent = F.round(F.col("l_discount") * 100)
    return [
        F.col("l_shipdate").alias("FL_DATE"),
        _carrier().alias("OP_CARRIER"),
        F.when(quantity != 13, F.col("s_tail")).alias("TAIL_NUM"),
        F.col("l_partkey").cast("string").alias("OP_CARRIER_FL_NUM"),
        (F.col("c_nationkey") + 10000).cast("string").alias("ORIGIN_AIRPORT_ID"),
        F.col("c_code").alias("ORIGIN"),
        F.col("c_city").alias("ORIGIN_CITY_NAME"),
        (F.col("s_nationkey") + 10000).cast("string").alias("DEST_AIRPORT_ID"),
        F.col("s_code").alias("DESTINATION"),
        F.col("s_city").alias("DEST_CITY_NAME"),
        F.when(~((line == 5) & (quantity > 45)), late).alias("DEP_DELAY"),
        (quantity / 2 + line - 18).alias("ARR_DELAY"),
        F.when(line == 7, 1.0).otherwise(0.0).alias("CANCELLED"),
        ((gap * 100 + 200) / 8).cast("double").alias("AIR_TIME"),
        (gap * 100 + 200).cast("double").alias("DISTANCE"),
        ((percent * 3 + 20) / 64).alias("OCCUPANCY_RATE"),
    ]


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legs(spark, sf_dir).select(*_flight_columns())


def _ticket_columns() -> list[Column]:
    return [
        F.col("l_orderkey").cast("string").alias("ITIN_ID"),
        F.year("l_shipdate").alias("YEAR"),
        F.quarter("l_shipdate").alias("QUARTER"),
        F.col("c_code").alias("ORIGIN"),
        F.lit("US").alias("ORIGIN_COUNTRY"),
        F.concat(F.lit("S"), _letter("c_nationkey")).alias("ORIGIN_STATE_ABR"),
        F.concat(F.lit("State "), _letter("c_nationkey")).alias("ORIGIN_STATE_NM"),
        F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(1.0).alias("ROUNDTRIP"),
        _carrier().alias("REPORTING_CARRIER"),
        F.col("l_quantity").alias("PASSENGERS"),
        (F.floor(F.col("l_extendedprice") / 25) / 4).alias("ITIN_FARE"),
        F.col("s_code").alias("DESTINATION"),
    ]


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legs(spark, sf_dir).select(*_ticket_columns())


def flights_and_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights with the YEAR and QUARTER of their date."""
    dated = flights(spark, sf_dir)
    return dated.withColumns({"YEAR": F.year("FL_DATE"), "QUARTER": F.quarter("FL_DATE")})


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One airport per nation; the last one has no code, so its routes stay unmatched."""
    key = F.col("n_nationkey")
    size = (
        F.when(key % 3 == 0, "large_airport")
        .when(key % 3 == 1, "medium_airport")
        .otherwise("small_airport")
    )
    lon = ((key * 5 + 60) * -1 - 0.5).cast("string")
    lat = (key + 20.25).cast("string")
    return table(spark, sf_dir, "nation").select(
        size.alias("TYPE"),
        F.concat(F.lit("Airport "), "n_name").alias("NAME"),
        (key * 137.5).alias("ELEVATION_FT"),
        _city("n_nationkey").alias("MUNICIPALITY"),
        F.when(key != 24, _code("n_nationkey")).alias("IATA_CODE"),
        F.concat(lon, F.lit(", "), lat).alias("COORDINATES"),
    )


def raw_nation_airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``airports`` as raw text, one elevation in words, the continent lost as a missing value."""
    key = F.col("n_nationkey")
    words = F.when(key == 3, "Nine Hundred").otherwise((key * 137).cast("string"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_name"), key)
    plain = airports(spark, sf_dir).drop("ELEVATION_FT").join(
        nations.select(F.concat(F.lit("Airport "), "n_name").alias("NAME"), words.alias("ELEVATION_FT")),
        "NAME",
    )
    return plain.select(
        "TYPE", "NAME", "ELEVATION_FT", F.lit(None).cast("string").alias("CONTINENT"),
        F.lit("US").alias("ISO_COUNTRY"), "MUNICIPALITY", "IATA_CODE", "COORDINATES",
    )


def edge_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text number, word and date per line item, each row of the table included."""
    quantity, line = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    numbers = F.array(*[F.lit(v) for v in EDGE_NUMBERS])
    words = F.array(*[F.lit(v) for v in EDGE_WORDS])
    date = (
        F.when(quantity % 5 == 0, F.date_format("l_shipdate", "M/d/yy"))
        .when(quantity % 5 == 1, F.date_format("l_shipdate", "yyyy-MM-dd"))
        .when(quantity % 5 == 2, F.date_format("l_shipdate", "MM/dd/yyyy"))
        .when(quantity % 5 == 3, F.concat(F.lit("13/"), line.cast("string"), F.lit("/98")))
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.get(numbers, (line + quantity) % len(EDGE_NUMBERS)).alias("RAW_NUM"),
        F.get(words, line - 1).alias("RAW_WORD"),
        date.alias("RAW_DATE"),
    )


def sparse_airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that 98 of 100 rows lack, and one that 90 of 100 lack."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("Airport "), "c_name").alias("NAME"),
        F.when(key % 50 == 0, F.col("c_acctbal")).alias("ELEVATION_FT"),
        F.when(key % 10 == 0, _city("c_nationkey")).alias("MUNICIPALITY"),
    )


def hot_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items of which a third share one order and some have none; orders, some without key."""
    line = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(line <= 2, 1).when(line != 7, F.col("l_orderkey")).cast("long").alias("ORDER_KEY"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey")).alias("PLACED_KEY"), "o_orderstatus"
    )
    return lines, orders


def quiet_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights whose departure delays to and from one city are all unknown."""
    known = (F.col("ORIGIN_CITY_NAME") != "City A") & (F.col("DEST_CITY_NAME") != "City A")
    return flights(spark, sf_dir).withColumn("DEP_DELAY", F.when(known, F.col("DEP_DELAY")))


def quiet_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets whose passengers to and from one airport are all unknown."""
    known = (F.col("ORIGIN") != "AAA") & (F.col("DESTINATION") != "AAA")
    return tickets(spark, sf_dir).withColumn("PASSENGERS", F.when(known, F.col("PASSENGERS")))


def coded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group for each line item that its code settles, unknown for some; one code is missing."""
    code = F.col("l_partkey") % 150
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("ROW_KEY"),
        F.when(code != 149, F.concat(F.lit("C"), code.cast("string"))).alias("CODE"),
        F.col("l_linestatus").alias("FLAG"),
        F.when(F.col("l_quantity") != 9, F.concat(F.lit("G"), (code % 7).cast("string"))).alias(
            "GROUP_NAME"
        ),
    )


def sided_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of two sides for each line item, settled by its part (many), unknown for some."""
    side = F.when(F.col("l_partkey") % 2 == 0, "even").otherwise("odd")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("ROW_KEY"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("PART"),
        F.when(F.col("l_quantity") != 9, side).alias("SIDE"),
    )


def _with_repeats(df: DataFrame) -> DataFrame:
    """Every row, and the rows of line number 3 once more, from one pass over the joins."""
    again = F.when(F.col("l_linenumber") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("_again", F.explode(again)).drop("_again")


def raw_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights as dirty text: words, junk, missing values and repeated rows."""
    quantity = F.col("l_quantity")
    legs = _with_repeats(_legs(spark, sf_dir))
    clean = legs.select("l_quantity", *_flight_columns())
    text = {c: F.col(c).cast("string") for c in clean.columns if c not in ("l_quantity", "FL_DATE")}
    dirty = clean.withColumns(text).withColumns(
        {
            "FL_DATE": F.when(quantity == 7, "soon").otherwise(
                F.date_format("FL_DATE", "yyyy-MM-dd")
            ),
            "DISTANCE": F.when(quantity == 3, "Five Hundred")
            .when(quantity == 4, "8.9abc")
            .otherwise(F.col("DISTANCE")),
            "AIR_TIME": F.when(quantity == 11, "Thirty Five").otherwise(F.col("AIR_TIME")),
            "OCCUPANCY_RATE": F.when(quantity != 5, F.col("OCCUPANCY_RATE")),
        }
    )
    return dirty.drop("l_quantity")


def raw_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets as dirty text, repeated rows included."""
    quantity = F.col("l_quantity")
    legs = _with_repeats(_legs(spark, sf_dir))
    clean = legs.select("l_quantity", *_ticket_columns())
    text = {c: F.col(c).cast("string") for c in clean.columns if c != "l_quantity"}
    dirty = clean.withColumns(text).withColumns(
        {
            "PASSENGERS": F.when(quantity == 20, "Twenty").otherwise(F.col("PASSENGERS")),
            "ITIN_FARE": F.when(quantity == 21, "1,200").otherwise(F.col("ITIN_FARE")),
            "ORIGIN_STATE_NM": F.when(quantity != 9, F.col("ORIGIN_STATE_NM")),
        }
    )
    return dirty.drop("l_quantity")


def raw_airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dirty airport per customer; the continent code is lost as a missing value."""
    key, feet = F.col("c_custkey"), F.floor(F.col("c_acctbal"))
    nation = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        F.when(key % 3 == 0, "large_airport")
        .when(key % 3 == 1, "medium_airport")
        .otherwise("small_airport")
        .alias("TYPE"),
        F.concat(F.lit("Airport "), "c_name").alias("NAME"),
        F.when(nation == 3, "Nine Hundred")
        .when(nation == 4, "high")
        .otherwise(feet.cast("string"))
        .alias("ELEVATION_FT"),
        F.lit(None).cast("string").alias("CONTINENT"),
        F.when(nation == 5, "CA").otherwise("US").alias("ISO_COUNTRY"),
        F.when(nation != 6, _city("c_nationkey")).alias("MUNICIPALITY"),
        F.when(nation != 7, _code("c_nationkey")).alias("IATA_CODE"),
        F.concat((nation * -5 - 60.5).cast("string"), F.lit(", "), (nation + 20.25).cast("string"))
        .alias("COORDINATES"),
    )
