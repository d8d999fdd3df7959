"""Quality control file by file against one run over all files."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from checks import proxy
from skyledger.plans import incremental
from skyledger.plans.incremental import QcStore, RouteStore
from skyledger.plans.qc import FLIGHT_PLAN, TICKET_PLAN, run_qc
from skyledger.plans.routes import route_kpis
from skyledger.sources.tables import read_raw_csv, write_table


def bag(df):
    order = sorted(df.columns)
    return Counter(
        tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*order).collect()
    )


def same(got, want):
    assert (got.dropped, got.capped) == (want.dropped, want.capped)
    assert got.cleaned.schema.simpleString() == want.cleaned.schema.simpleString()
    assert bag(got.cleaned) == bag(want.cleaned)
    assert set(got.reports) == set(want.reports)
    for name, report in want.reports.items():
        assert bag(got.reports[name]) == bag(report), name


@pytest.fixture(scope="module")
def thirds(spark, sf, tmp_path_factory):
    """Raw flights as three CSV files, rows that repeat each other across files among them."""
    raw = proxy.raw_flights(spark, sf).limit(1500).cache()
    root = tmp_path_factory.mktemp("raw")
    paths = []
    for i in range(3):
        paths.append(str(root / f"q{i}"))
        write_table(raw.where(F.abs(F.hash("OP_CARRIER_FL_NUM")) % 3 == i), paths[-1], "csv")
    write_table(raw.limit(200), paths[2] + "more", "csv")
    return [*paths, paths[2] + "more"]


def test_a_merge_equals_a_run_over_all_files(spark, thirds, tmp_path, monkeypatch):
    store = QcStore(spark, str(tmp_path / "store"), FLIGHT_PLAN)
    with pytest.raises(ValueError, match="no file"):
        store.merged()
    for name in thirds[:2]:
        store.add(name, read_raw_csv(spark, name))
    same(store.merged(), run_qc(read_raw_csv(spark, thirds[:2]), FLIGHT_PLAN))

    parsed = []
    convert = incremental.convert_audited
    monkeypatch.setattr(
        incremental, "convert_audited", lambda df, *a: (parsed.append(df), convert(df, *a))[1]
    )
    for name in thirds[2:]:
        store.add(name, read_raw_csv(spark, name))
    files = [f for df in parsed for f in df.inputFiles()]
    assert files and all(thirds[2] in f for f in files)  # only the new files' text is read
    same(store.merged(), run_qc(read_raw_csv(spark, thirds), FLIGHT_PLAN))


def test_replaced_forgotten_and_stopped_half_way(spark, thirds, tmp_path, monkeypatch):
    store = QcStore(spark, str(tmp_path / "store"), FLIGHT_PLAN)
    for name, path in (("a", thirds[0]), ("b", thirds[3]), ("a", thirds[2]), ("c", thirds[1])):
        store.add(name, read_raw_csv(spark, path))
    store.forget("b")
    store.forget("never there")
    want = run_qc(read_raw_csv(spark, [thirds[2], thirds[1]]), FLIGHT_PLAN)
    same(store.merged(), want)
    monkeypatch.setattr(incremental, "null_counts", lambda df: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.add("a", read_raw_csv(spark, thirds[0]))
    monkeypatch.undo()
    same(store.merged(), want)


def test_empty_files_and_columns_without_a_value(spark, sf, tmp_path):
    raw = proxy.raw_tickets(spark, sf).limit(300).withColumn("ORIGIN_COUNTRY", F.lit(None).cast("string"))
    store = QcStore(spark, str(tmp_path / "store"), TICKET_PLAN)
    store.add("none", raw.limit(0))
    store.add("all", raw)
    got = store.merged()
    same(got, run_qc(raw, TICKET_PLAN))
    assert got.dropped == ["ORIGIN_COUNTRY"]
    alone = QcStore(spark, str(tmp_path / "empty"), TICKET_PLAN)
    alone.add("none", raw.limit(0))
    same(alone.merged(), run_qc(raw.limit(0), TICKET_PLAN))


@pytest.mark.parametrize("period", [(), ("YEAR", "QUARTER"), ("YEAR",)])
def test_kpis_of_stored_sums_equal_a_rebuild(spark, sf, tmp_path, period):
    flights, tickets = proxy.flights_and_periods(spark, sf), proxy.tickets(spark, sf)
    airports = proxy.airports(spark, sf)
    store = RouteStore(spark, str(tmp_path / "sums"), ("YEAR", "QUARTER"))
    odd = F.hash("ORIGIN") % 2 == 0
    for name, rows in (("a", odd), ("b", ~odd), ("b", ~odd)):
        store.add_flights(name, flights.where(rows))
        store.add_tickets(name, tickets.where(rows))
    store.add_flights("late", flights.limit(50))
    store.forget("flights late")
    got, want = store.kpis(airports, period=period), route_kpis(flights, tickets, airports, period=period)
    assert got.columns == want.columns and bag(got) == bag(want)


def test_sums_know_their_periods(spark, tmp_path):
    store = RouteStore(spark, str(tmp_path / "sums"), ("YEAR",))
    with pytest.raises(ValueError, match="QUARTER"):
        store.kpis(None, period=("QUARTER",))
    with pytest.raises(ValueError, match="no file of flights"):
        store.kpis(None)
