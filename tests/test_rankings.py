"""Many rankings in one pass, and routes kept in buckets."""

import re

import pytest
from pyspark.sql import functions as F

from checks import proxy
from checks.queries import extended_table, kpi_table
from skyledger.operators.joins import join_flights_tickets
from skyledger.operators.ranking import Ranking, ascending, descending, top_each, top_k
from skyledger.plans import colocated, explore, routes

ROWS = [
    ("r1", "c1", 5, 1.5), ("r1", "c2", 5, None), ("r2", "c1", None, -2.0), ("r3", "c1", 9, 0.0),
    ("r4", None, 1, 7.0), ("r3", "c1", 9, 0.0), (None, None, None, None),
    ("r5", "c1", 2**53 + 1, 3.0), ("r6", "c1", 2**53, 3.0),
]
SCHEMA = "ROUTE string, CARRIER string, n long, x double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lists(found):
    out = {}
    for r in found.orderBy("RANKING", "POSITION").collect():
        out.setdefault(r.RANKING, []).append(tuple(r)[2:])
    return out


def test_each_ranking_is_that_of_top_k(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    positive = F.col("x") > 0
    got = lists(
        top_each(
            df,
            {
                "most": Ranking(("n",), 4),
                "least": Ranking(("x",), 3, least=True),
                "both": Ranking(("n", "x"), 20),
                "some": Ranking(("n",), 5, where=positive),
                "none": Ranking(("n",), 5, where=F.lit(False)),
            },
        )
    )
    rows = lambda found: [tuple(r) for r in found.collect()]
    assert got == {
        "most": rows(top_k(df, descending("n"), 4)),
        "least": rows(top_k(df, ascending("x"), 3)),
        "both": rows(top_k(df, descending("n", "x"), 20)),
        "some": rows(top_k(df.where(positive), descending("n"), 5)),
    }
    assert got["most"][0][0] == "r5"  # longs are compared as such
    assert top_each(df.limit(0), {"a": Ranking(("n",))}).count() == 0
    with pytest.raises(ValueError):
        top_each(df, {})
    with pytest.raises(ValueError):
        top_each(df.withColumn("POSITION", F.lit(1)), {"a": Ranking(("n",))})


def test_rankings_share_one_scan_and_one_shuffle(spark, sf, tmp_path):
    path = str(tmp_path / "kpis")
    extended_table(spark, sf).write.parquet(path)
    stored = spark.read.parquet(path)
    found = explore.leaders(stored)
    text = plan(found)
    assert len(re.findall(r"FileScan", text)) == 1
    assert len(re.findall(r"Exchange ", text)) == 1
    assert re.search(r"WindowGroupLimit.*Final[\s\S]*Exchange[\s\S]*WindowGroupLimit.*Partial", text)
    got = lists(found.select("RANKING", "POSITION", "ROUTE_NAME_CITY", "CARRIER"))
    for metric, n in explore.LEADERS.items():
        want = explore.top_by(stored, metric, n).select("ROUTE_NAME_CITY", "CARRIER").collect()
        assert got[metric] == [tuple(r) for r in want]


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, value in before.items():
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def same(a, b):
    a, b = ([tuple(r) for r in x.collect()] for x in (a, b))
    assert a
    assert sorted(a, key=str) == sorted(b, key=str)


@pytest.mark.parametrize("period", [(), ("YEAR", "QUARTER")])
def test_bucketed_routes_meet_without_a_shuffle(spark, sf, tmp_path, no_broadcast, period):
    kept = colocated.RouteTables(spark, f"kept{len(period)}", str(tmp_path), 6, period)
    flights = proxy.flights_and_periods(spark, sf) if period else proxy.flights(spark, sf)
    tickets, airports = proxy.tickets(spark, sf), proxy.airports(spark, sf)
    kept.write_tickets(tickets)
    kept.write_flights(flights.limit(10))
    kept.write_flights(flights)  # again: overwrites
    try:
        text = plan(join_flights_tickets(kept.flights(), kept.tickets(), period))
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert "Exchange" in plan(
            join_flights_tickets(
                spark.read.parquet(f"{tmp_path}/flights"), spark.read.parquet(f"{tmp_path}/tickets"),
                period,
            )
        )
        want = routes.route_kpis(flights, tickets, airports, period=period)
        got = kept.kpis(airports)
        assert got.columns == want.columns
        rounded = lambda df: df.select(
            *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
        )
        same(rounded(got), rounded(want))
    finally:
        kept.drop()


def test_one_file_for_each_bucket_and_empty_tables(spark, sf, tmp_path):
    kept = colocated.RouteTables(spark, "one", str(tmp_path), 4)
    try:
        kept.write_flights(proxy.flights(spark, sf))
        assert len(list((tmp_path / "flights").glob("part-*"))) <= 4
        kept.write_tickets(proxy.tickets(spark, sf).limit(0))
        assert kept.kpis(proxy.airports(spark, sf)).count() == 0
    finally:
        kept.drop()
    assert kpi_table(spark, sf).count() > 0
