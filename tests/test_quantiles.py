import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyledger.operators import quantiles
from skyledger.operators.quantiles import Extent, exact_medians, exact_quantiles

POINTS = [0.0, 0.25, 0.5, 0.75, 1.0]


def check(spark, values, **options):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = exact_quantiles(df, {"x": POINTS}, **options)["x"]
    known = [v for v in values if v is not None]
    expected = np.quantile(known, POINTS) if known else [None] * len(POINTS)
    assert found == [None if e is None else pytest.approx(e, rel=1e-12, abs=1e-12) for e in expected]


@pytest.mark.parametrize("options", [{}, {"bins": 4, "finish_rows": 3}, {"bins": 2, "finish_rows": 0}])
@settings(max_examples=6, deadline=None)
@given(values=st.lists(st.none() | st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_matches_numpy(spark, options, values):
    check(spark, values, **options)


@pytest.mark.parametrize("options", [{}, {"bins": 16, "finish_rows": 10}])
def test_hot_value_and_heavy_tail(spark, options):
    values = [7.0] * 500 + [float(i) for i in range(500)] + [1e300, -1e300, 1e-300]
    check(spark, values, **options)


def test_a_sketch_brackets_and_may_miss(spark):
    rng = np.random.default_rng(5)
    values = np.exp(rng.normal(0, 40, 20_000)).tolist() + [3.0] * 9_000
    check(spark, values, finish_rows=500, accuracy=1000)
    check(spark, values, finish_rows=10, bins=16, accuracy=3)  # brackets hardly narrow anything


def test_wrong_brackets_cost_passes_not_answers(spark, monkeypatch):
    def wrong(values, ranks, accuracy):
        for i, r in enumerate(ranks):
            r.bracket = (90.0, 95.0, 5) if i % 2 else (1.0, 2.0, 5)

    monkeypatch.setattr(quantiles, "_bracketed", wrong)
    check(spark, [float(i) for i in range(100)], finish_rows=20)


def test_constant_empty_and_null_columns(spark):
    check(spark, [3.0, 3.0, 3.0])
    check(spark, [None, None])
    assert exact_quantiles(spark.createDataFrame([], "x double"), {"x": [0.5]}) == {"x": [None]}
    assert exact_quantiles(spark.createDataFrame([], "x double"), {}) == {}


def test_many_columns_at_once(spark):
    rng = np.random.default_rng(1)
    table = rng.normal(size=(2000, 3)) * [1, 1000, 1e-3]
    df = spark.createDataFrame([tuple(map(float, r)) for r in table], "a double, b double, c double")
    found = exact_medians(df, ["a", "b", "c"], bins=8, finish_rows=20, cache=True)
    for i, c in enumerate("abc"):
        assert found[c] == pytest.approx(np.median(table[:, i]), rel=1e-12)


def test_whole_numbers(spark):
    df = spark.range(1, 1002)
    assert exact_quantiles(df, {"id": [0.5]}, bins=10, finish_rows=5) == {"id": [501.0]}


def test_approximate(spark):
    df = spark.range(0, 10_001)
    found = exact_quantiles(df, {"id": [0.25, 0.5]}, exact=False)["id"]
    assert found == [pytest.approx(2500, abs=5), pytest.approx(5000, abs=5)]


def test_infinities_nan_and_the_smallest_doubles(spark):
    inf, nan, tiny = float("inf"), float("nan"), 5e-324
    df = spark.createDataFrame([(v,) for v in (-inf, nan, 0.0, tiny, 1.0, None, inf)], "x double")
    for options in ({}, {"bins": 2, "finish_rows": 0}):
        found = exact_quantiles(df, {"x": POINTS}, **options)["x"]
        assert found == [-inf, 0.0, tiny, 1.0, inf]


def test_log_spread_values(spark):
    check(spark, [10.0**e for e in range(-9, 10)], bins=64, finish_rows=5)


def test_summaries_bracket_and_may_be_wrong(spark, monkeypatch):
    passes = []
    advance = quantiles._advance
    monkeypatch.setattr(quantiles, "_advance", lambda *a: (passes.append(1), advance(*a)))
    values = np.random.default_rng(3).normal(size=30_000)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    right = np.quantile(values, POINTS)
    exact = tuple(np.quantile(values, np.linspace(0, 1, 65)).tolist())
    for depth, most in ((exact, 2), (tuple(v + 1 for v in exact), 6), ((0.0,) * 65, 6), (None, 6)):
        passes.clear()
        extent = Extent(len(values), float(values.min()), float(values.max()), depth)
        found = exact_quantiles(df, {"x": POINTS}, extents={"x": extent}, finish_rows=10_000, bins=64)
        assert found["x"] == [pytest.approx(e, rel=1e-12) for e in right]
        assert len(passes) <= most


def test_a_filled_summary_keeps_its_depth():
    extent = Extent(64_000, 0.0, 64.0, tuple(float(i) for i in range(65)))
    full = extent.filled(32.0, 64_000)
    assert (full.count, full.low, full.high) == (128_000, 0.0, 64.0)
    values = np.sort(np.concatenate([np.linspace(0, 64, 64_000), np.full(64_000, 32.0)]))
    assert full.depth == pytest.approx(np.quantile(values, np.linspace(0, 1, 65)), abs=1)
    assert extent.filled(None, 5) is extent and Extent(0, None, None).filled(1.0, 5).count == 0
    far = extent.distances(16.0)
    assert (far.low, far.high) == (0.0, 48.0) and list(far.depth) == sorted(far.depth)
