"""One query per operator over the driver tables: ``name -> (spark, sf_dir) -> DataFrame``.

Dates leave as text, and figures whose last bits depend on the order of addition are
rounded, so that they can be compared with another engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import proxy
from skyledger.functions import text
from skyledger.functions.money import round_half_even
from skyledger.operators import aggregates as agg
from skyledger.operators import cleaning, joins, kpis, outliers, prediction, quality, ranking
from skyledger.params import SweetSpot
from skyledger.plans import answers, colocated, explore, files, incremental, qc, routes
from skyledger.sources import audit, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NAMED = ("City A -> City B", "City D -> City E", "City G -> City K", "City J -> City W")
SMALL_SPOT = SweetSpot(min_profit=500_000.0, max_delay=10.0, min_passengers=10_000.0)
EDGE_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
EDGE_KINDS = {"RAW_NUM": "float", "RAW_WORD": "int", "RAW_DATE": "date"}
LEG_MEASURES = ["DEP_DELAY", "ARR_DELAY", "DISTANCE"]


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def iso(column: str):
    return F.date_format(column, "yyyy-MM-dd")


def six(df: DataFrame, *columns: str, scale: int = 6) -> DataFrame:
    return df.withColumns({c: round_half_even(F.col(c), scale) for c in columns})


def kpi_table(spark: SparkSession, sf: str) -> DataFrame:
    return routes.route_kpis(
        proxy.flights(spark, sf), proxy.tickets(spark, sf), proxy.airports(spark, sf)
    )


def medium_large_table(spark: SparkSession, sf: str) -> DataFrame:
    return kpi_table(spark, sf).transform(ranking.medium_large)


def extended_table(spark: SparkSession, sf: str) -> DataFrame:
    return kpi_table(spark, sf).transform(routes.route_kpis_extended)


def quarterly_table(spark: SparkSession, sf: str) -> DataFrame:
    return routes.route_kpis(
        proxy.flights_and_periods(spark, sf),
        proxy.tickets(spark, sf),
        proxy.airports(spark, sf),
        period=("YEAR", "QUARTER"),
    )


def typed_flights(spark: SparkSession, sf: str) -> DataFrame:
    """The dirty flights after conversion."""
    worded = cleaning.clean_numeric_columns(proxy.raw_flights(spark, sf), qc.FLIGHT_PLAN.worded)
    rest = {c: k for c, k in qc.FLIGHT_KINDS.items() if c not in qc.FLIGHT_PLAN.worded}
    return cleaning.convert_columns(worded, rest)


def staged(build: Query, spark: SparkSession, sf: str) -> DataFrame:
    """A derived table written once, ahead of operators that pass over it several times."""
    return tables.stage(build(spark, sf), build.__name__)


def by_direction(spark: SparkSession, sf: str) -> DataFrame:
    return agg.flights_by_direction(proxy.flights(spark, sf))


def by_route(spark: SparkSession, sf: str) -> DataFrame:
    return agg.flights_by_route(by_direction(spark, sf))


def sold(spark: SparkSession, sf: str) -> DataFrame:
    return agg.tickets_by_route(proxy.tickets(spark, sf))


# --- sources and sinks --------------------------------------------------------------


@query("s01_read_raw_csv")
def _(spark, sf):
    path = tables.staging_path(spark, "raw_csv")
    cells = proxy.edge_cells(spark, sf)
    tables.write_table(cells, path, "csv")
    return tables.read_raw_csv(spark, path, cells.columns)


@query("s02_read_clean")
def _(spark, sf):
    return tables.read_clean(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("s02_read_clean_nan")
def _(spark, sf):
    """NaN in a file is a missing value once read."""
    quantity = F.when(F.col("l_quantity") == 7, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    lines = proxy.table(spark, sf, "lineitem")
    path = tables.staging_path(spark, "nan")
    tables.write_table(lines.select("l_orderkey", "l_linenumber", quantity.alias("QUANTITY")), path)
    return tables.read_clean(spark, path, ["l_orderkey", "l_linenumber", "QUANTITY"])


@query("s03_write_parquet")
def _(spark, sf):
    return tables.stage(proxy.tickets(spark, sf), "tickets")


@query("s03_write_csv")
def _(spark, sf):
    path = tables.staging_path(spark, "airports_csv")
    raw = proxy.raw_airports(spark, sf)
    tables.write_table(raw, path, "csv")
    return tables.read_raw_csv(spark, path, raw.columns)


# --- cleaning and projection --------------------------------------------------------


@query("c01_word_number")
def _(spark, sf):
    cells = proxy.edge_cells(spark, sf)
    return cells.select(*EDGE_KEYS, "RAW_WORD", text.word_number(F.col("RAW_WORD")).alias("VALUE"))


@query("c02_clean_numeric")
def _(spark, sf):
    raw = F.col("RAW_NUM")
    return proxy.edge_cells(spark, sf).select(
        *EDGE_KEYS,
        "RAW_NUM",
        text.clean_numeric(raw).alias("VALUE"),
        text.clean_numeric(raw, "signed").alias("SIGNED_VALUE"),
    )


@query("c03_clean_numeric_columns")
def _(spark, sf):
    raw = proxy.raw_flights(spark, sf)
    cleaned = cleaning.clean_numeric_columns(raw, ["AIR_TIME", "DISTANCE", "OCCUPANCY_RATE"])
    return cleaned.select("OP_CARRIER_FL_NUM", "TAIL_NUM", "AIR_TIME", "DISTANCE", "OCCUPANCY_RATE")


@query("c04_standardize_date")
def _(spark, sf):
    return proxy.edge_cells(spark, sf).select(
        *EDGE_KEYS, "RAW_DATE", text.standardize_date(F.col("RAW_DATE")).alias("ISO_DATE")
    )


@query("c05_audit_conversions")
def _(spark, sf):
    audited = cleaning.audit_conversions(proxy.edge_cells(spark, sf), EDGE_KINDS)
    return audited.withColumn("RAW_DATE_converted", iso("RAW_DATE_converted"))


@query("c06_classify_conversion_error")
def _(spark, sf):
    raw = F.col("RAW_NUM")
    error = text.conversion_error(raw, text.parse_number(raw))
    return proxy.edge_cells(spark, sf).select(*EDGE_KEYS, "RAW_NUM", error.alias("e")).select(
        *EDGE_KEYS, "RAW_NUM", "e.error_type", "e.detail"
    )


@query("c07_conversion_error_report")
def _(spark, sf):
    return cleaning.conversion_error_report(proxy.edge_cells(spark, sf), EDGE_KINDS)


@query("c07_audit_store")
def _(spark, sf):
    """The report of the entry above, read from a store that the converting pass leaves."""
    edge = proxy.edge_cells(spark, sf).select(*EDGE_KINDS)
    parsed = tables.stage(cleaning.convert_audited(edge, EDGE_KINDS), "converted")
    store = audit.AuditStore(spark, tables.staging_path(spark, "audit"))
    store.write(parsed, {"before": cleaning.all_failed("_failed", "_before")})
    return store.report("before")


@query("c08_fill_by_type")
def _(spark, sf):
    typed = typed_flights(spark, sf)
    for c in ("OCCUPANCY_RATE", "TAIL_NUM", "FL_DATE", "DEP_DELAY"):
        typed = cleaning.fill_by_type(typed, c, qc.FLIGHT_KINDS[c])
    return typed.select(
        "OP_CARRIER", "TAIL_NUM", "DEP_DELAY", "OCCUPANCY_RATE", iso("FL_DATE").alias("FL_DATE")
    )


@query("c09_parse_date_parts")
def _(spark, sf):
    dated = cleaning.parse_date_parts(proxy.raw_flights(spark, sf))
    return dated.select("OP_CARRIER", "TAIL_NUM", iso("FL_DATE").alias("FL_DATE"), "YEAR", "MONTH")


@query("c10_symmetric_key")
def _(spark, sf):
    key = text.symmetric_key(F.col("ORIGIN"), F.col("DESTINATION"))
    cities = text.symmetric_key(F.col("ORIGIN_CITY_NAME"), F.col("DEST_CITY_NAME"), " -> ")
    return proxy.flights(spark, sf).select(
        "ORIGIN", "DESTINATION", key.alias("ROUTE_KEY"), cities.alias("ROUTE_NAME_CITY")
    )


@query("c11_split_route")
def _(spark, sf):
    key = text.symmetric_key(F.col("ORIGIN"), F.col("DESTINATION"))
    keyed = proxy.tickets(spark, sf).select("ITIN_ID", key.alias("ROUTE_KEY"))
    strict = joins.split_route(keyed, strict=True).withColumnsRenamed(
        {"AIRPORT_A": "STRICT_A", "AIRPORT_B": "STRICT_B"}
    )
    return joins.split_route(strict)


@query("c12_parse_coordinates")
def _(spark, sf):
    packed = F.col("COORDINATES")
    return proxy.raw_airports(spark, sf).select(
        "NAME", text.longitude(packed).alias("LON"), text.latitude(packed).alias("LAT")
    )


@query("c13_to_route_schema")
def _(spark, sf):
    return routes.joined_routes(
        proxy.flights(spark, sf), proxy.tickets(spark, sf), proxy.airports(spark, sf)
    )


@query("c14_round_money")
def _(spark, sf):
    amounts = proxy.table(spark, sf, "lineitem").select(
        *EDGE_KEYS,
        (F.col("l_extendedprice") * F.col("l_discount")).alias("DISCOUNT"),
        (F.col("l_extendedprice") / 8).alias("EIGHTH"),
    )
    return cleaning.round_money(amounts, ["DISCOUNT", "EIGHTH"])


@query("c15_project")
def _(spark, sf):
    return kpi_table(spark, sf).select(
        "ROUTE_NAME_CITY", "AIRPORT_CODE_A", "AIRPORT_CODE_B", "TOTAL_FLIGHTS", "PROFIT"
    )


# --- nulls, duplicates, kinds, imputation -------------------------------------------


@query("q01_null_profile")
def _(spark, sf):
    return six(quality.null_profile(proxy.raw_flights(spark, sf)), "null_pct")


@query("q02_null_patterns")
def _(spark, sf):
    return quality.null_patterns(typed_flights(spark, sf))


@query("q03_classify_columns")
def _(spark, sf):
    return quality.column_kinds(staged(proxy.flights, spark, sf), ordinal=["CANCELLED"])


@query("q04_drop_all_null_columns")
def _(spark, sf):
    return quality.drop_all_null_columns(proxy.raw_airports(spark, sf))[0]


@query("q05_drop_high_null_columns")
def _(spark, sf):
    return quality.drop_high_null_columns(proxy.sparse_airports(spark, sf), threshold=95)[0]


@query("q06_duplicate_stats")
def _(spark, sf):
    return six(quality.duplicate_stats(proxy.raw_tickets(spark, sf)), "duplicate_pct")


@query("q06_duplicate_stats_subset")
def _(spark, sf):
    raw = proxy.raw_tickets(spark, sf)
    return six(quality.duplicate_stats(raw, ["ITIN_ID", "REPORTING_CARRIER"]), "duplicate_pct")


@query("q07_drop_duplicates")
def _(spark, sf):
    return quality.drop_duplicates(proxy.raw_tickets(spark, sf))


@query("q07_drop_duplicates_subset")
def _(spark, sf):
    columns = ["OP_CARRIER", "ORIGIN", "DESTINATION", "TAIL_NUM", "OP_CARRIER_FL_NUM", "DISTANCE"]
    flights = proxy.raw_flights(spark, sf).select(*columns)
    return quality.drop_duplicates(
        flights, ["OP_CARRIER", "ORIGIN", "DESTINATION"], ["OP_CARRIER_FL_NUM", "TAIL_NUM", "DISTANCE"]
    )


@query("q08_impute_median_mode")
def _(spark, sf):
    typed = staged(typed_flights, spark, sf)
    full = quality.impute(typed, ["DEP_DELAY", "OCCUPANCY_RATE", "DISTANCE"], ["TAIL_NUM"])
    return full.select("OP_CARRIER", "ORIGIN", "TAIL_NUM", "DEP_DELAY", "OCCUPANCY_RATE", "DISTANCE")


@query("q08_impute_mean_constant")
def _(spark, sf):
    typed = staged(typed_flights, spark, sf)
    full = quality.impute(
        typed, ["DEP_DELAY", "DISTANCE"], ["TAIL_NUM", "OCCUPANCY_RATE"], "mean", "constant", "Unknown"
    )
    return full.select("OP_CARRIER", "ORIGIN", "TAIL_NUM", "DEP_DELAY", "OCCUPANCY_RATE", "DISTANCE")


@query("q09_impute_predicted")
def _(spark, sf):
    """A feature of 150 values, one of them missing, settles the target; another tells nothing."""
    cases = proxy.coded_lines(spark, sf)
    filled = prediction.impute_predicted(cases, "GROUP_NAME", ["CODE", "FLAG"])
    return filled.select("ROW_KEY", "CODE", "FLAG", "GROUP_NAME")


@query("q09_impute_two_classes")
def _(spark, sf):
    """Two classes, and a feature of as many values as there are parts: it enters as digits."""
    cases = staged(proxy.sided_lines, spark, sf)
    return prediction.impute_predicted(cases, "SIDE", ["PART"], num_trees=20, max_width=40)


@query("q09_impute_predicted_exactly")
def _(spark, sf):
    """One feature that settles the target: the forest has to get every gap right."""
    raw = staged(proxy.raw_tickets, spark, sf)
    filled = prediction.impute_predicted(raw, "ORIGIN_STATE_NM", ["ORIGIN_STATE_ABR"])
    return filled.select("ITIN_ID", "ORIGIN_STATE_ABR", "ORIGIN_STATE_NM")


@query("q10_column_profile")
def _(spark, sf):
    profile = quality.column_profile(staged(typed_flights, spark, sf))
    return six(profile, "mean", "std")


@query("q10_correlations")
def _(spark, sf):
    return six(quality.correlations(proxy.flights(spark, sf)), "corr")


# --- filters ------------------------------------------------------------------------


def _kept(spark, sf, strict):
    typed = typed_flights(spark, sf)
    allowed = {"CANCELLED": [0.0], "TAIL_NUM": ["N1", "N2", "N3"]}
    result = quality.filter_allowed(typed, allowed, ["TAIL_NUM", "DEP_DELAY"], strict)
    return result.rows.select("OP_CARRIER", "ORIGIN", "DESTINATION", "TAIL_NUM", "CANCELLED")


@query("f01_filter_allowed")
def _(spark, sf):
    return _kept(spark, sf, False)


@query("f01_filter_allowed_strict")
def _(spark, sf):
    return _kept(spark, sf, True)


@query("f01a_filter_airports")
def _(spark, sf):
    return quality.filter_allowed(proxy.raw_airports(spark, sf), qc.AIRPORT_ALLOWED).rows


@query("f01b_filter_flights")
def _(spark, sf):
    kept = quality.filter_allowed(proxy.flights(spark, sf), qc.FLIGHT_ALLOWED).rows
    return kept.select("OP_CARRIER", "ORIGIN", "DESTINATION", "DISTANCE", "CANCELLED")


@query("f01c_filter_tickets")
def _(spark, sf):
    return quality.filter_allowed(proxy.tickets(spark, sf), qc.TICKET_ALLOWED).rows


@query("f02_medium_large")
def _(spark, sf):
    return medium_large_table(spark, sf)


@query("f03_positive")
def _(spark, sf):
    kept = ranking.positive(medium_large_table(spark, sf), "TOTAL_COST", "TOTAL_REVENUE")
    return kept.select("ROUTE", "CARRIER", "TOTAL_COST", "TOTAL_REVENUE")


def _money_summary(df):
    """Sums of cents are cents again."""
    return six(
        df.withColumns({"PROFIT": round_half_even(F.col("PROFIT"))}),
        "AVG_TOTAL_DELAY_MINUTES", "ESTIMATED_PASSENGERS", "ROUND_TRIP_DISTANCE_MILES",
    )


@query("f04_sweet_spot")
def _(spark, sf):
    summary = agg.route_summary(medium_large_table(spark, sf))
    return _money_summary(ranking.sweet_spot(summary, SMALL_SPOT))


@query("f05_named_routes")
def _(spark, sf):
    named = ranking.named_routes(kpi_table(spark, sf), NAMED)
    return named.select("ROUTE_NAME_CITY", "CARRIER", "PROFIT", "TOTAL_FLIGHTS")


@query("f06_balanced_cost")
def _(spark, sf):
    balanced = ranking.balanced_cost(staged(medium_large_table, spark, sf))
    return balanced.select(
        "ROUTE", "CARRIER", "PROFIT", "MILEAGE_COST_PCT", "AIRPORT_FEES_PCT", "DELAY_COST_PCT"
    )


# --- joins --------------------------------------------------------------------------


def _airport_sides(spark, sf):
    """Both sides hold a missing code and one the other lacks."""
    raw = proxy.raw_airports(spark, sf).select("NAME", "IATA_CODE")
    known = proxy.airports(spark, sf).select(
        F.col("IATA_CODE").alias("CODE"), "TYPE", "ELEVATION_FT"
    )
    return raw, known


def _joined(how: str, **options) -> Query:
    def run(spark, sf):
        return joins.join_on(*_airport_sides(spark, sf), ["IATA_CODE"], ["CODE"], how, **options)

    return run


for _how in ("inner", "left", "right", "outer"):
    QUERIES[f"j01_join_on_{_how}"] = _joined(_how)
QUERIES["j01_join_on_null_safe"] = _joined("left", null_safe=True)


def _hot_joined(how: str) -> Query:
    def run(spark, sf):
        lines, orders = proxy.hot_lines(spark, sf)
        return joins.join_on(lines, orders, ["ORDER_KEY"], ["PLACED_KEY"], how)

    return run


for _how in ("left", "right", "outer"):
    QUERIES[f"j01_join_on_{_how}_hot_keys"] = _hot_joined(_how)


@query("j02_join_on_key_hot_keys")
def _(spark, sf):
    lines, orders = proxy.hot_lines(spark, sf)
    return joins.join_on_key(
        lines, orders.withColumnRenamed("PLACED_KEY", "ORDER_KEY"), "ORDER_KEY", "outer"
    )


def _joined_on_key(null_safe: bool) -> Query:
    def run(spark, sf):
        raw, known = _airport_sides(spark, sf)
        named = raw.groupBy(F.col("IATA_CODE").alias("CODE")).agg(F.count("*").alias("NAMES"))
        return joins.join_on_key(named, known, "CODE", "outer", null_safe)

    return run


QUERIES["j02_join_on_key"] = _joined_on_key(False)
QUERIES["j02_join_on_key_null_safe"] = _joined_on_key(True)


@query("j03_equi_join")
def _(spark, sf):
    lines = proxy.table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    orders = proxy.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return joins.join_on(lines, orders, ["l_orderkey"], ["o_orderkey"])


@query("j04_join_flights_tickets")
def _(spark, sf):
    return joins.join_flights_tickets(by_route(spark, sf), sold(spark, sf))


@query("j05_add_airport")
def _(spark, sf):
    ends = joins.split_route(sold(spark, sf))
    return joins.add_airport(ends, proxy.airports(spark, sf), "B")


@query("j06_enrich_routes")
def _(spark, sf):
    return joins.enrich_routes(by_route(spark, sf), sold(spark, sf), proxy.airports(spark, sf))


# --- aggregations -------------------------------------------------------------------


@query("a01_flights_by_direction")
def _(spark, sf):
    return by_direction(spark, sf)


@query("a02_flights_by_route")
def _(spark, sf):
    return by_route(spark, sf)


@query("a02_flights_by_route_weighted")
def _(spark, sf):
    return agg.flights_by_route(by_direction(spark, sf), weighted=True)


@query("a03_tickets_by_route")
def _(spark, sf):
    return sold(spark, sf)


@query("a04_route_summary")
def _(spark, sf):
    return _money_summary(agg.route_summary(medium_large_table(spark, sf)))


@query("a05_sum_by_route")
def _(spark, sf):
    sums = agg.sum_by_route(medium_large_table(spark, sf), "PROFIT")
    return sums.withColumn("PROFIT", round_half_even(F.col("PROFIT")))


def quiet_table(spark: SparkSession, sf: str) -> DataFrame:
    """KPIs of which those of one city's routes cannot be known."""
    return routes.route_kpis(
        proxy.quiet_flights(spark, sf), proxy.quiet_tickets(spark, sf), proxy.airports(spark, sf)
    )


@query("a03_tickets_by_route_unknown")
def _(spark, sf):
    return agg.tickets_by_route(proxy.quiet_tickets(spark, sf))


@query("a04_route_summary_unknown")
def _(spark, sf):
    return _money_summary(agg.route_summary(quiet_table(spark, sf)))


@query("a05_sum_by_route_unknown")
def _(spark, sf):
    sums = agg.sum_by_route(quiet_table(spark, sf), "PROFIT")
    return sums.withColumn("PROFIT", round_half_even(F.col("PROFIT")))


@query("a07_delay_metrics_unknown")
def _(spark, sf):
    delays = agg.delay_metrics(quiet_table(spark, sf))
    return six(
        delays.withColumn("DELAY_COST", round_half_even(F.col("DELAY_COST"))), "AVG_TOTAL_DELAY_MINUTES"
    )


@query("k07_delay_cost_unknown")
def _(spark, sf):
    return quiet_table(spark, sf).select(
        "ROUTE", "CARRIER", "AVG_DEP_DELAY_MINUTES", "DELAY_COST", "TOTAL_COST", "PROFIT"
    )


@query("a06_flights_per_route")
def _(spark, sf):
    return agg.flights_per_route(medium_large_table(spark, sf))


@query("a07_delay_metrics")
def _(spark, sf):
    delays = agg.delay_metrics(medium_large_table(spark, sf))
    return six(
        delays.withColumn("DELAY_COST", round_half_even(F.col("DELAY_COST"))), "AVG_TOTAL_DELAY_MINUTES"
    )


def _described(df):
    return six(agg.describe_numeric(df, explore.DESCRIBED), "mean", "std", scale=4)


@query("a08_describe_all")
def _(spark, sf):
    return _described(staged(kpi_table, spark, sf))


@query("a08_describe_medium_large")
def _(spark, sf):
    return _described(staged(medium_large_table, spark, sf))


@query("a09_min_max")
def _(spark, sf):
    return agg.min_max(medium_large_table(spark, sf), "TOTAL_COST")


@query("a10_profit_histogram")
def _(spark, sf):
    histogram = agg.profit_histogram(staged(medium_large_table, spark, sf))
    return six(histogram, "bin_low", "bin_high", scale=4)


@query("a11_box_stats")
def _(spark, sf):
    return agg.box_stats(staged(medium_large_table, spark, sf), ["PROFIT", "DELAY_COST"])


# --- outliers -----------------------------------------------------------------------


def _priced(spark, sf):
    return proxy.table(spark, sf, "lineitem").select(
        *EDGE_KEYS, "l_quantity", "l_extendedprice",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
    )


@query("o01_outlier_flags_zscore")
def _(spark, sf):
    return outliers.outlier_flags(_priced(spark, sf), ["l_extendedprice", "unit_price"], "zscore", z=1.5)


@query("o02_outlier_flags_iqr")
def _(spark, sf):
    return outliers.outlier_flags(_priced(spark, sf), ["l_extendedprice", "unit_price"], "iqr")


@query("o03_outlier_summary_iqr")
def _(spark, sf):
    columns = [*LEG_MEASURES, "OCCUPANCY_RATE"]
    return outliers.outlier_summary(staged(proxy.flights, spark, sf), columns, "iqr")


@query("o03_outlier_summary_zscore")
def _(spark, sf):
    columns = [*LEG_MEASURES, "OCCUPANCY_RATE"]
    return outliers.outlier_summary(staged(proxy.flights, spark, sf), columns, "zscore", z=2.0)


@query("o04_cap_mad")
def _(spark, sf):
    return outliers.cap_mad(_priced(spark, sf), ["l_quantity", "unit_price"], k=1.0)


@query("o05_cap_mad_report")
def _(spark, sf):
    flights = staged(proxy.flights, spark, sf)
    return six(outliers.cap_mad_report(flights, LEG_MEASURES, k=1.0)[1], "capped_pct")


# --- rankings -----------------------------------------------------------------------


def _answer(fn, *args) -> Query:
    return lambda spark, sf: fn(kpi_table(spark, sf), *args)


QUERIES["r01_busiest"] = _answer(answers.busiest)
QUERIES["r02_most_profitable"] = _answer(answers.most_profitable)
QUERIES["r03_recommended"] = _answer(answers.recommended)
QUERIES["r04_most_demanded"] = _answer(answers.most_demanded)
QUERIES["r05_most_punctual"] = _answer(answers.most_punctual)
QUERIES["r06_busiest_grouped"] = _answer(answers.busiest_grouped)
QUERIES["r07_best_revenue_to_cost"] = _answer(answers.best_revenue_to_cost)
QUERIES["r08_best_balanced"] = lambda spark, sf: answers.best_balanced(staged(kpi_table, spark, sf))
QUERIES["r09_breakeven"] = _answer(answers.breakeven, NAMED)


@query("r10_top_cities_passengers")
def _(spark, sf):
    best = explore.top_cities(medium_large_table(spark, sf), "ESTIMATED_PASSENGERS")
    return six(best, "ESTIMATED_PASSENGERS")


@query("r10_top_cities_profit")
def _(spark, sf):
    best = explore.top_cities(medium_large_table(spark, sf), "PROFIT")
    return best.withColumn("PROFIT", round_half_even(F.col("PROFIT")))


@query("r11_least_delayed_cities")
def _(spark, sf):
    return six(explore.least_delayed_cities(medium_large_table(spark, sf)), "AVG_TOTAL_DELAY_MINUTES")


@query("r12_top_with_coordinates")
def _(spark, sf):
    return explore.top_with_coordinates(medium_large_table(spark, sf))


@query("r13_final_candidates")
def _(spark, sf):
    return _money_summary(explore.best_sweet_spots(medium_large_table(spark, sf), 5, SMALL_SPOT))


@query("r13_sweet_spots")
def _(spark, sf):
    return _money_summary(explore.best_sweet_spots(medium_large_table(spark, sf), 10, SMALL_SPOT))


def _explored(fn, *args) -> Query:
    return lambda spark, sf: fn(medium_large_table(spark, sf), *args)


QUERIES["r14_revenue_mix"] = _explored(explore.revenue_mix)
QUERIES["r15_cost_breakdown"] = _explored(explore.cost_breakdown)
QUERIES["r16_costliest_delays"] = _explored(explore.costliest_delays)
QUERIES["r17_highest_fares"] = _explored(explore.highest_fares)
QUERIES["r18_distance_and_cost"] = _explored(explore.distance_and_cost)


def _worst(by: str) -> Query:
    def run(spark, sf):
        worst = explore.worst_delays(medium_large_table(spark, sf), by)
        cents = worst.withColumn("DELAY_COST", round_half_even(F.col("DELAY_COST")))
        return six(cents, "AVG_TOTAL_DELAY_MINUTES")

    return run


QUERIES["r19_worst_mean_delay"] = _worst("AVG_TOTAL_DELAY_MINUTES")
QUERIES["r19_worst_delay_cost"] = _worst("DELAY_COST")


def _top(metric: str, n: int = 10, *also: str) -> Query:
    return lambda spark, sf: explore.top_by(extended_table(spark, sf), metric, n, also)


QUERIES["r20_top_margin"] = _top("PROFIT_MARGIN_PCT")
QUERIES["r21_top_profit_per_flight"] = _top("PROFIT_PER_FLIGHT")
QUERIES["r22_top_profit_per_passenger"] = _top("PROFIT_PER_PASSENGER", 10, "COST_PER_PASSENGER")
QUERIES["r23_top_revenue_per_passenger"] = _top("REVENUE_PER_PASSENGER", 10, "COST_PER_PASSENGER")
QUERIES["r24_top_baggage_share"] = _top("BAGGAGE_REVENUE_PCT")
QUERIES["r25_top_frequency"] = _top("FLIGHTS_PER_1000_MILES")
QUERIES["r26_top_profit_and_distance"] = _top(
    "PROFIT", 10, "ROUND_TRIP_DISTANCE_MILES", "ESTIMATED_PASSENGERS", "PROFIT_MARGIN_PCT"
)
QUERIES["r27_top_passengers_and_delay"] = _top(
    "ESTIMATED_PASSENGERS", 50, "TOTAL_DELAY_MINUTES", "PROFIT", "AVG_DEP_DELAY_MINUTES"
)


@query("r20_leaders")
def _(spark, sf):
    """The lists of the eight entries above in one pass."""
    best = explore.leaders(extended_table(spark, sf))
    value = F.coalesce(
        *[F.when(F.col("RANKING") == c, F.col(c).cast("double")) for c in explore.LEADERS]
    )
    return best.select("RANKING", "POSITION", "ROUTE_NAME_CITY", "CARRIER", value.alias("VALUE"))


@query("r28_null_order")
def _(spark, sf):
    return quality.null_profile(typed_flights(spark, sf)).select("column_name", "null_count")


QUERIES["r29_occupancy_and_distance"] = _explored(explore.occupancy_and_distance)
QUERIES["r30_cost_and_revenue"] = _explored(explore.cost_and_revenue)


# --- KPIs ---------------------------------------------------------------------------


def _kpi(*columns: str) -> Query:
    return lambda spark, sf: kpi_table(spark, sf).select("ROUTE", "CARRIER", *columns)


QUERIES["k01_estimated_passengers"] = _kpi("ESTIMATED_PASSENGERS")
QUERIES["k02_ticket_revenue"] = _kpi("TICKET_REVENUE")
QUERIES["k03_baggage_revenue"] = _kpi("BAGGAGE_REVENUE")
QUERIES["k04_total_revenue"] = _kpi("TOTAL_REVENUE")
QUERIES["k05_mileage_cost"] = _kpi("ROUND_TRIP_DISTANCE_MILES", "MILEAGE_COST")
QUERIES["k06_airport_fees"] = _kpi("AIRPORT_FEES")
QUERIES["k07_delay_cost"] = _kpi("DELAY_COST")
QUERIES["k08_profit"] = _kpi("TOTAL_COST", "PROFIT")


def _ratio(step, *columns: str) -> Query:
    return lambda spark, sf: kpi_table(spark, sf).transform(step).select("ROUTE", "CARRIER", *columns)


QUERIES["k09_profit_margin"] = _ratio(kpis.add_margin, "PROFIT_MARGIN_PCT")
QUERIES["k10_per_passenger"] = _ratio(
    kpis.add_per_passenger, "COST_PER_PASSENGER", "REVENUE_PER_PASSENGER", "PROFIT_PER_PASSENGER"
)
QUERIES["k11_flights_per_1000_miles"] = _ratio(kpis.add_frequency, "FLIGHTS_PER_1000_MILES")
QUERIES["k12_cost_shares"] = _ratio(
    kpis.add_cost_shares, "MILEAGE_COST_PCT", "AIRPORT_FEES_PCT", "DELAY_COST_PCT"
)
QUERIES["k13_per_flight"] = _ratio(
    kpis.add_per_flight,
    "PASSENGERS_PER_FLIGHT", "REVENUE_PER_FLIGHT", "PROFIT_PER_FLIGHT", "COST_PER_FLIGHT",
)
QUERIES["k14_total_delay"] = _ratio(kpis.add_total_delay, "AVG_TOTAL_DELAY")
QUERIES["k15_breakeven_flights"] = _ratio(
    kpis.add_breakeven, "PROFIT_PER_FLIGHT", "BREAKEVEN_FLIGHTS"
)


@query("k16_revenue_to_cost")
def _(spark, sf):
    both = kpi_table(spark, sf).transform(kpis.add_revenue_to_cost).transform(kpis.add_profit_million)
    return both.select("ROUTE", "CARRIER", "REV_TO_COST_RATIO", "PROFIT_MILLION")


@query("w01_passenger_growth")
def _(spark, sf):
    return kpis.passenger_growth(quarterly_table(spark, sf)).select(
        "ROUTE", "CARRIER", "YEAR", "QUARTER", "ESTIMATED_PASSENGERS", "PASSENGER_GROWTH_PCT"
    )


@query("w02_breakeven_tracker")
def _(spark, sf):
    return kpis.breakeven_tracker(quarterly_table(spark, sf)).select(
        "ROUTE", "CARRIER", "YEAR", "QUARTER", "PROFIT", "CUMULATIVE_PROFIT", "BREAKEVEN_PROGRESS"
    )


@query("w03_occupancy_rate")
def _(spark, sf):
    return kpis.add_occupancy(kpi_table(spark, sf)).select("ROUTE", "CARRIER", "OCCUPANCY_RATE")


# --- pipelines ----------------------------------------------------------------------


@query("p01_clean_airports")
def _(spark, sf):
    return qc.clean_airports(proxy.raw_airports(spark, sf)).cleaned


@query("p02_clean_flights")
def _(spark, sf):
    return qc.clean_flights(proxy.raw_flights(spark, sf)).cleaned


@query("p03_clean_tickets")
def _(spark, sf):
    return qc.clean_tickets(proxy.raw_tickets(spark, sf)).cleaned


@query("p04_route_kpis")
def _(spark, sf):
    return kpi_table(spark, sf)


@query("p04_route_kpis_from_raw")
def _(spark, sf):
    flights = qc.clean_flights(proxy.raw_flights(spark, sf)).cleaned
    tickets = qc.clean_tickets(proxy.raw_tickets(spark, sf)).cleaned
    return routes.route_kpis(flights, tickets, proxy.airports(spark, sf))


@query("p07_files_to_kpis")
def _(spark, sf):
    """Raw CSV files to cleaned tables to the KPI table, each written and read back."""
    raw = {
        "flights": proxy.raw_flights, "tickets": proxy.raw_tickets,
        "airports": proxy.raw_nation_airports,
    }
    paths = {name: tables.staging_path(spark, f"{name}_csv") for name in raw}
    for name, build in raw.items():
        tables.write_table(build(spark, sf), paths[name], "csv")
    kept = files.Tables(tables.staging_path(spark, "files"))
    files.clean_files(spark, paths, kept)
    return files.kpi_file(spark, kept)


@query("p08_incremental_flights")
def _(spark, sf):
    """Flights as they come in, carrier by carrier, merged from what each file's rows tell."""
    folder = tables.staging_path(spark, "store")
    store = incremental.QcStore(spark, folder, qc.FLIGHT_PLAN)
    raw = staged(proxy.raw_flights, spark, sf)
    for first in ("A", "N", "R"):
        store.add(first, raw.where(F.col("OP_CARRIER").startswith(first)))
    return store.merged().cleaned


@query("p09_incremental_kpis")
def _(spark, sf):
    """The KPI table from sums kept by quarter for each file of flights and of tickets."""
    store = incremental.RouteStore(
        spark, tables.staging_path(spark, "sums"), ("YEAR", "QUARTER")
    )
    flights = staged(proxy.flights_and_periods, spark, sf)
    tickets = staged(proxy.tickets, spark, sf)
    for first in ("A", "N", "R"):
        store.add_flights(first, flights.where(F.col("OP_CARRIER").startswith(first)))
        store.add_tickets(first, tickets.where(F.col("REPORTING_CARRIER").startswith(first)))
    return store.kpis(proxy.airports(spark, sf))


@query("p10_colocated_kpis")
def _(spark, sf):
    """The KPI table from bucketed routes."""
    folder = tables.staging_path(spark, "buckets")
    kept = colocated.RouteTables(spark, f"routes_{folder[-32:]}", folder, 8)
    kept.write_flights(proxy.flights(spark, sf))
    kept.write_tickets(proxy.tickets(spark, sf))
    return kept.kpis(proxy.airports(spark, sf))


@query("p05_route_kpis_extended")
def _(spark, sf):
    return extended_table(spark, sf)


@query("p06_answers")
def _(spark, sf):
    metric = {
        "busiest": "TOTAL_FLIGHTS", "most_profitable": "PROFIT", "recommended": "PROFIT_MILLION",
        "most_demanded": "ESTIMATED_PASSENGERS", "most_punctual": "AVG_TOTAL_DELAY",
        "busiest_grouped": "TOTAL_FLIGHTS", "best_revenue_to_cost": "REV_TO_COST_RATIO",
        "best_balanced": "PROFIT", "breakeven": "BREAKEVEN_FLIGHTS",
    }
    found = answers.answers(staged(kpi_table, spark, sf), NAMED)
    lists = [
        df.select(
            F.lit(name).alias("ANSWER"), "ROUTE_NAME_CITY", F.col(metric[name]).cast("double").alias("VALUE")
        )
        for name, df in found.items()
    ]
    together = lists[0]
    for other in lists[1:]:
        together = together.unionByName(other)
    return together
