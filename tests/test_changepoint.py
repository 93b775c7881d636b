import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxlake.operators import changepoint as cp

rng = np.random.default_rng(17)


def levels(*parts, noise=0.04):
    """Noisy levels of given lengths."""
    return [float(np.clip(v + rng.normal(0, noise), -1, 1)) for v, n in parts for _ in range(n)]


SERIES = {f"step{i}": levels((a, n), (b, m)) for i, (a, n, b, m) in enumerate([(0.7, 9, -0.4, 12), (-0.5, 7, 0.6, 8), (0.2, 15, -0.8, 6), (-0.9, 5, -0.1, 20)])}
SERIES |= {f"level{i}": levels((v, n), noise=0.01) for i, (v, n) in enumerate([(0.3, 11), (-0.2, 25)])}
SERIES |= {"two": levels((0.5, 2)), "four": levels((0.9, 2), (-0.9, 2)), "three": levels((0.6, 8), (-0.6, 9), (0.5, 7))}
STEPS = {"step0": 9, "step1": 7, "step2": 15, "step3": 5}


@pytest.fixture(scope="module")
def series(spark):
    rows = [(k, 7 * i + 1, v) for k, vs in SERIES.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "call_id string, turn_index int, score double")


def test_shifts_are_found_where_levels_change(series):
    got = {r["call_id"]: r for r in cp.mood_shifts(series).collect()}
    assert set(got) == {*STEPS, "three"}
    for key, at in STEPS.items():
        values, r = SERIES[key], got[key]
        pos = (r["turn_index"] - 1) // 7
        assert abs(pos - at) <= 1
        assert r["before_mean"] == pytest.approx(np.mean(values[:pos])) and r["after_mean"] == pytest.approx(np.mean(values[pos:]))
        assert r["delta"] == pytest.approx(r["after_mean"] - r["before_mean"])


def test_single_split_finds_the_same_steps(series):
    got = {r["call_id"]: (r["turn_index"] - 1) // 7 for r in cp.single_split(series).collect()}
    assert all(abs(got[k] - at) <= 2 for k, at in STEPS.items()) and not {"level0", "level1", "two", "four"} & set(got)


@pytest.mark.parametrize("width", [2, 3, 4096])
def test_smoothing_keeps_length_and_ignores_block_width(series, width):
    got = {}
    for r in cp.smooth(cp.positions(series, width), width).orderBy("call_id", "pos").collect():
        got.setdefault(r["call_id"], []).append(r["smoothed"])
    for key, values in SERIES.items():
        want = values if len(values) < 3 else [float(np.mean(values[max(0, i - 1): i + 2])) for i in range(len(values))]
        assert got[key] == pytest.approx(want)


def cost(x):
    return float(((x - x.mean()) ** 2).sum())


def cheapest(values, penalty):
    n, best = len(values), math.inf
    for k in range(n // 2):
        for cuts in itertools.combinations(range(2, n - 1), k):
            edges = [0, *cuts, n]
            if all(b - a >= 2 for a, b in zip(edges, edges[1:])):
                best = min(best, sum(cost(values[a:b]) for a, b in zip(edges, edges[1:])) + penalty * k)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([-1.0, -0.4, 0.0, 0.3, 0.9]), min_size=5, max_size=11), st.sampled_from([0.05, 0.3, 1.0]))
def test_breaks_are_optimal(values, penalty):
    x = np.array(values)
    cuts = cp.best_breaks(x, penalty)
    edges = [0, *cuts, len(x)]
    assert all(b - a >= 2 for a, b in zip(edges, edges[1:]))
    price = sum(cost(x[a:b]) for a, b in zip(edges, edges[1:])) + penalty * len(cuts)
    assert price == pytest.approx(cheapest(x, penalty), abs=1e-9)


def test_series_across_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(k, i, v) for k, vs in SERIES.items() for i, v in enumerate(vs)]
        s = spark.createDataFrame(rows, "call_id string, turn_index int, score double")
        few = {(r["call_id"], r["break_pos"]) for r in cp.breaks(cp.smooth(cp.positions(s))).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert few == {(r["call_id"], r["break_pos"]) for r in cp.breaks(cp.smooth(cp.positions(s))).collect()}
    assert {k for k, _ in few} >= {*STEPS, "three"}


def test_reportable_shift_filters(spark):
    down, up = SERIES["step0"], SERIES["step1"]
    above = [v + 1.2 for v in levels((0.6, 8), (-0.7, 8))]  # falls, but stays pleasant
    yes = lambda i: True
    cases = {"down": (down, yes, yes), "up": (up, yes, yes), "above": (above, yes, yes), "unquotable": (down, yes, lambda i: False), "thin": (down, lambda i: i < 4, yes)}
    rows = [(k, i, v, s(i), c(i)) for k, (vs, s, c) in cases.items() for i, v in enumerate(vs)]
    p = spark.createDataFrame(rows, "call_id string, turn_index int, score double, substantive boolean, citable boolean")
    assert [r["call_id"] for r in cp.reportable_shifts(p).collect()] == ["down"]
