import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.llm import hard_negatives as module
from voxlake.llm.hard_negatives import Layout, _angles, _norms, _windows, bounds, hard_negatives

COLUMNS = "vec_id long, label int, embedding array<double>, score long, anchor string"


def brute(rows, positives=5, negatives=3, low=50, high=95, scale=256):
    kept = {(i, k, tuple(v)) for i, k, v in rows if None not in (i, k, v) and all(x is not None and math.isfinite(x) for x in v)}
    kept = [(i, k, [math.floor(scale * x) for x in v]) for i, k, v in kept]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, k, v in kept:
        if i % 5 == 0:
            scored = sorted((-dot(v, w), j, m == k) for j, m, w in kept if j != i)
            for p, j, _ in [x for x in scored if x[2]][:positives]:
                fit = [x for x in scored if not x[2] and low * -p <= 100 * -x[0] <= high * -p][:negatives]
                out += [(i, j, r + 1, n, -p, -s) for r, (s, n, _) in enumerate(fit)]
    return sorted(out)


def run(spark, rows, **more):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], COLUMNS).repartition(3)
    return sorted(tuple(r) for r in hard_negatives(table, F.col("vec_id") % 5 == 0, **more).collect())


def clustered(seed, n=260, dims=6, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    rows = []
    for i in range(n):
        k = int(rng.integers(labels))
        rows.append((i, k, (centres[k] * rng.choice([0.2, 1, 3]) + rng.normal(size=dims) * 0.6).tolist()))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(module, "ANCHORS_AT_ONCE", 5)
    rows = clustered(seed)
    got = run(spark, rows, window=7, block_bytes=8 * 6 * 20)  # several blocks of at most 20 anchors
    assert got == brute(rows) and len(got) > 100


def test_nulls_bad_components_repeated_rows_ties_and_unlike_lengths(spark):
    rows = clustered(3, 60)
    rows += [(60, 1, None), (None, 1, [1.0] * 6), (65, None, [1.0] * 6), (70, 2, [float("nan")] + [1.0] * 5), (75, 2, [float("inf")] * 6), (80, 2, [None] + [1.0] * 5)]
    rows += [(90, 1, []), (95, 1, [0.0] * 6), (100, 2, [1.0, 2.0]), (105, 9, [1.0] * 6)]
    rows += [(200 + i, i % 2, [1.0, 0.5, 0.25, 0.0, 0.0, 0.0]) for i in range(20)]  # ties
    rows += rows[:7] + [(0, 3, [0.5] * 6)]  # again, and one id with another vector
    assert run(spark, rows) == brute(rows)


def test_negative_and_zero_scores(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 2, [-0.7, 0.1]), (4, 2, [0.0, 0.3]), (5, 2, [0.0, -1.0])]
    assert run(spark, rows) == brute(rows)


def test_large_numbers_stay_exact(spark):
    rows = [(i, i % 2, [2.0**21 + i * 0.125, 2.0**20 - i, -1.0 / (i + 1)]) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_empty_tables(spark):
    assert run(spark, []) == [] and run(spark, [(1, None, None)]) == [] and run(spark, [(0, 1, [])]) == [] and run(spark, [(0, 1, [1.0])]) == []


@pytest.mark.parametrize("size", [1e-3, 1.0, 1e4])
def test_bounds_hold_every_score(size):
    rng = np.random.default_rng(7)
    for dims in (1, 2, 64):
        x = np.floor(rng.normal(size=(500, dims)) * 256 * size)
        x[::17] = 0
        x[1::17] = x[2]
        x[3::17] = -x[2]
        anchors = x[::9]
        directions = x[[4, 5, 6]] / np.maximum(_norms(x[[4, 5, 6]]), 1e-9)[:, None]
        low, high = bounds(_angles(anchors, directions), _norms(anchors), _windows(_angles(x, directions), _norms(x)))
        scores = anchors @ x.T
        which = np.arange(500) // module.WINDOW
        assert (scores >= low[:, which]).all() and (scores <= high[:, which]).all()


def test_narrow_groups_are_passed_over(spark, monkeypatch):
    """Windows far from an anchor in angle are never scored."""
    rng = np.random.default_rng(2)
    angles = np.sort(np.concatenate([rng.uniform(0, 0.4, 512), rng.uniform(2.0, 2.4, 512)]))
    x = np.floor(256 * np.stack([np.cos(angles), np.sin(angles)], axis=1))
    low, high = bounds(_angles(x, np.eye(2)), _norms(x), _windows(_angles(x, np.eye(2)), _norms(x)))
    assert (high[:512, 2:] < low[:512, :2].max(axis=1)[:, None]).all()


def test_layout_is_exact_where_products_grow():
    assert [Layout(64, m, 1).exact for m in (160, 1 << 20, 1 << 30)] == [np.float32, np.float64, object]
