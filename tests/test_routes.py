import pytest
from pyspark.sql import functions as F

from skyledger.operators import aggregates, joins, ranking
from skyledger.operators.cleaning import ROUTE_SCHEMA
from skyledger.params import SweetSpot
from skyledger.plans import answers, explore
from skyledger.plans.routes import route_kpis, route_kpis_extended


@pytest.fixture
def tables(spark):
    flights = spark.createDataFrame(
        [
            ("C", "AAA", "BBB", "City A", "City B", "N1", 100.0, 0.5, 10.0, 0.0),
            ("C", "AAA", "BBB", "City A", "City B", None, 100.0, 0.5, 30.0, 0.0),
            ("C", "BBB", "AAA", "City B", "City A", "N2", 100.0, 0.5, 40.0, 0.0),
            ("C", None, "AAA", "City B", "City A", "N3", 100.0, 0.5, 99.0, 0.0),
            ("D", "AAA", "BBB", "City A", "City B", "N4", 100.0, 0.5, None, 0.0),
        ],
        "OP_CARRIER string, ORIGIN string, DESTINATION string, ORIGIN_CITY_NAME string, "
        "DEST_CITY_NAME string, TAIL_NUM string, DISTANCE double, OCCUPANCY_RATE double, "
        "DEP_DELAY double, ARR_DELAY double",
    )
    tickets = spark.createDataFrame(
        [("AAA", "BBB", "C", 2.0, 100.0), ("BBB", "AAA", "C", 3.0, 200.0), ("AAA", "BBB", "D", 1.0, 50.0),
         ("AAA", None, "C", 9.0, 9.0)],
        "ORIGIN string, DESTINATION string, REPORTING_CARRIER string, PASSENGERS double, ITIN_FARE double",
    )
    airports = spark.createDataFrame(
        [("medium_airport", "Alpha", 10.0, "A-town", "AAA", "1.5, 2.5"),
         ("large_airport", "Beta", None, "B-town", "BBB", "3, 4"),
         ("large_airport", "Nowhere", 1.0, "N", None, "0, 0")],
        "TYPE string, NAME string, ELEVATION_FT double, MUNICIPALITY string, IATA_CODE string, COORDINATES string",
    )
    return flights, tickets, airports


def test_direction_then_route(tables):
    directions = aggregates.flights_by_direction(tables[0])
    assert directions.count() == 3  # a missing airport belongs to no direction
    route = aggregates.flights_by_route(directions).where("OP_CARRIER = 'C'").first()
    assert route["DEP_DELAY"] == 30.0  # mean of 20 and 40, not of 10, 30 and 40
    assert route["TOTAL_FLIGHTS"] == 2  # one tail number is missing
    weighted = aggregates.flights_by_route(directions, weighted=True).where("OP_CARRIER = 'C'").first()
    assert weighted["DEP_DELAY"] == 30.0 and weighted["ROUTE_NAME_CITY"] == "City A -> City B"


def test_tickets(tables):
    row = aggregates.tickets_by_route(tables[1]).where("REPORTING_CARRIER = 'C'").first()
    assert (row["ROUTE_KEY"], row["PASSENGERS"], row["ITIN_FARE"]) == ("AAA-BBB", 5.0, 150.0)


def test_enrich_and_schema(tables):
    kpis = route_kpis(*tables)
    assert set(ROUTE_SCHEMA.values()) <= set(kpis.columns)
    row = kpis.where("CARRIER = 'C'").first()
    assert (row["AIRPORT_A_NAME"], row["AIRPORT_B_CITY"], row["AIRPORT_B_ELEVATION_FT"]) == ("Alpha", "B-town", None)
    assert row["DELAY_COST"] == 15 * 75 * 2
    assert kpis.where("CARRIER = 'D'").first()["PROFIT"] is None
    assert route_kpis_extended(kpis).count() == 2


def test_unmatched_airport_stays(tables):
    flights, tickets, airports = tables
    kpis = route_kpis(flights, tickets, airports.where("IATA_CODE = 'AAA'"))
    row = kpis.where("CARRIER = 'C'").first()
    assert row["AIRPORT_B_SIZE"] is None and row["AIRPORT_FEES"] == 30_000.0
    assert ranking.medium_large(kpis).isEmpty()


def test_joins(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([("a", 3), (None, 4)], "q string, w int")
    assert joins.join_on(left, right, ["k"], ["q"]).count() == 1
    assert joins.join_on(left, right, ["k"], ["q"], null_safe=True).count() == 2
    assert joins.join_on(left, right, ["k"], ["q"], "outer").count() == 3
    same = right.withColumnRenamed("q", "k")
    assert joins.join_on_key(left, same, "k", "left").columns == ["k", "v", "w"]
    assert joins.join_on_key(left, same, "k", "outer").count() == 3
    matched = joins.join_on_key(left, same, "k", "outer", null_safe=True)
    assert sorted(map(tuple, matched.collect()), key=str) == [("a", 1, 3), (None, 2, 4)]
    with pytest.raises(ValueError):
        joins.join_on_key(left, left, "k")
    with pytest.raises(ValueError):
        joins.join_on(left, right, ["k"], [])


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_join_in_parts_gives_the_same_rows(spark, how, null_safe):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("z", 5)], "k string, v int")
    right = spark.createDataFrame([("a", 6), ("a", 7), ("c", 8), (None, 9), ("z", 10)], "q string, w int")
    plain = joins.join_on(left, right, ["k"], ["q"], how, null_safe, hot_keys=False)
    parts = joins.join_on(left, right, ["k"], ["q"], how, null_safe, hot_keys=True)
    assert plain.dtypes == parts.dtypes
    assert sorted(map(str, plain.collect())) == sorted(map(str, parts.collect()))
    with pytest.raises(ValueError):
        joins.join_on(left, right, ["k"], ["q"], "cross")


def test_a_hot_key_of_an_outer_join_is_split(spark):
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(0, 60_000, 1, 6).selectExpr("if(id % 3 = 0, 1, id) as k", "uuid() as v")
        right = spark.range(0, 5_000, 1, 6).selectExpr("id as q", "uuid() as w")
        joined = joins.join_on(left, right, ["k"], ["q"], "outer")
        assert joined.count() == 20_000 + 40_000 + sum(1 for i in range(5000) if i % 3 == 0 and i != 1)
        whole = left.join(right, left["k"] == right["q"], "outer")
        rows = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in text
        assert rows(whole) > 20_000  # the plain join leaves the hot key in one task
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_a_hot_key_is_dealt_to_several_tasks(spark, monkeypatch, how, null_safe):
    monkeypatch.setattr(joins, "HOT_ROWS", 100)
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        # equal rows of one key, some without a key, and a key that is hot on the other side
        left = spark.range(3000).selectExpr(
            "case when id < 2000 then 1 when id < 2300 then null when id < 2303 then 2 else id end as k",
            "cast(id % 2 as int) as v",
        )
        right = spark.range(1200).selectExpr(
            "cast(case when id < 3 then 1 when id < 7 then null when id < 400 then 2"
            " when id < 800 then 7 else id + 2000 end as int) as q", "id % 3 as w",
        )
        plain = joins.join_on(left, right, ["k"], ["q"], how, null_safe, hot_keys=False)
        dealt = joins.join_on(left, right, ["k"], ["q"], how, null_safe)
        assert plain.dtypes == dealt.dtypes
        assert sorted(map(str, plain.collect())) == sorted(map(str, dealt.collect()))
        hot = dealt.where("k = 1 and w = 0").groupBy(F.spark_partition_id()).count()
        assert hot.agg(F.max("count")).first()[0] < 2000
        for hot_key in (left.where("k = 1"), left.where("k = 2303").limit(1)):
            alone = joins.join_on(hot_key, right.where("q = 5"), ["k"], ["q"], "left")
            assert alone.count() == hot_key.count()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_sums_of_unknown_groups_are_zero(spark):
    rows = [("x", None, None, None), ("x", None, None, None), ("y", 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(
        [(*r, 1.0, 1.0, 1.0) for r in rows],
        "ROUTE_NAME_CITY string, PROFIT double, DELAY_COST double, ESTIMATED_PASSENGERS double,"
        " AVG_DEP_DELAY_MINUTES double, AVG_ARR_DELAY_MINUTES double, ROUND_TRIP_DISTANCE_MILES double",
    )
    for found, column in (
        (aggregates.sum_by_route(df, "PROFIT"), "PROFIT"),
        (aggregates.delay_metrics(df), "DELAY_COST"),
        (aggregates.route_summary(df), "ESTIMATED_PASSENGERS"),
    ):
        assert {r["ROUTE_NAME_CITY"]: r[column] for r in found.collect()}["x"] == 0.0


def ranked(spark):
    rows = [("r1", "c", "x", 5.0), ("r2", "c", "x", 9.0), ("r3", "c", "y", None), ("r4", "c", "y", 9.0)]
    return spark.createDataFrame(rows, "ROUTE string, CARRIER string, ROUTE_NAME_CITY string, PROFIT double")


def test_nulls_rank_last_and_ties_by_route(spark):
    down = ranking.top_k(ranked(spark), ranking.descending("PROFIT"), 4).collect()
    up = ranking.top_k(ranked(spark), ranking.ascending("PROFIT"), 4).collect()
    assert [r["ROUTE"] for r in down] == ["r2", "r4", "r1", "r3"]
    assert [r["ROUTE"] for r in up] == ["r1", "r2", "r4", "r3"]


def test_best_and_first_per_group(spark):
    best = ranking.best_per_group(ranked(spark), ["ROUTE_NAME_CITY"], ranking.descending("PROFIT"))
    assert sorted(r["ROUTE"] for r in best.collect()) == ["r2", "r4"]
    assert sorted(r["ROUTE"] for r in ranking.first_stored(ranked(spark)).collect()) == ["r1", "r3"]


def test_named_routes_short_and_long(spark):
    df = ranked(spark)
    assert ranking.named_routes(df, ["x"]).count() == 2
    assert ranking.named_routes(df, ["x"] + [f"n{i}" for i in range(200)]).count() == 2


def test_sweet_spot_is_inclusive(spark):
    df = spark.createDataFrame([(10.0, 5.0, 7.0), (9.9, 5.0, 7.0), (10.0, 5.1, 7.0), (None, 1.0, 9.0)],
                               "PROFIT double, AVG_TOTAL_DELAY_MINUTES double, ESTIMATED_PASSENGERS double")
    assert ranking.sweet_spot(df, SweetSpot(10.0, 5.0, 7.0)).count() == 1


def test_balanced_cost(spark):
    df = spark.createDataFrame(
        [("a", 70.0, 30.0, 0.0, 100.0), ("b", 71.0, 29.0, 0.0, 100.0), ("c", 50.0, 40.0, 10.0, 100.0),
         ("d", 0.0, 0.0, 0.0, 0.0)],
        "ROUTE string, MILEAGE_COST double, AIRPORT_FEES double, DELAY_COST double, TOTAL_COST double")
    assert [r["ROUTE"] for r in ranking.balanced_cost(df).collect()] == ["a"]


def test_answers_and_exploration(tables):
    kpis = route_kpis(*tables)
    found = answers.answers(kpis, ["City A -> City B"])
    assert found["busiest"].first()["TOTAL_FLIGHTS"] == 2
    assert found["breakeven"].count() == 2
    assert found["recommended"].columns[-1] == "PROFIT_MILLION"
    routes = kpis.transform(ranking.medium_large)
    spot = explore.top_with_coordinates(routes).first()
    assert (spot["LON_A"], spot["LAT_A"], spot["LON_B"], spot["LAT_B"]) == (1.5, 2.5, 3.0, 4.0)


def test_histogram_and_box(spark):
    df = spark.createDataFrame([(float(i),) for i in range(-50, 51)] + [(None,)], "PROFIT double")
    bins = aggregates.profit_histogram(df).orderBy("bin").collect()
    assert len(bins) == 50 and bins[-1]["row_count"] == 3  # the maximum joins the last bin
    assert sum(r["loss_count"] for r in bins) == 50
    flat = aggregates.profit_histogram(df.select(F.lit(1.0).alias("PROFIT"))).collect()
    assert [(r["bin"], r["row_count"]) for r in flat] == [(0, 102)]
    box = aggregates.box_stats(spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, 100.0)], "x double"), ["x"]).first()
    assert (box["q1"], box["median"], box["q3"], box["whisker_high"], box["outlier_count"]) == (2.0, 3.0, 4.0, 4.0, 1)


def test_describe(spark):
    row = aggregates.describe_numeric(spark.range(1, 6), ["id"]).first()
    assert (row["count"], row["mean"], row["p25"], row["p50"], row["max"]) == (5, 3.0, 2.0, 3.0, 5.0)
    assert row["std"] == pytest.approx(1.5811388)
    empty = aggregates.describe_numeric(spark.range(0), ["id"]).first()
    assert (empty["count"], empty["p50"], empty["min"]) == (0, None, None)
