import datetime as dt
import random

import pytest

from voxlake.operators import repeats

T0 = dt.datetime(2020, 1, 1)
SCHEMA = "call_id int, customer_id string, cluster_id string, intent_label string, started_at timestamp"


def test_window_edges_and_ties(spark):
    at = [T0, T0, T0 + dt.timedelta(days=30), T0 + dt.timedelta(days=30, microseconds=1), T0 + dt.timedelta(days=61)]
    rows = [(i, "c", "k", "x", t) for i, t in enumerate(at)] + [(9, "c", None, "", at[3])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["call_id"]: r["repeat_count"] for r in repeats.prior_counts(df, ["customer_id", "cluster_id"], 30).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 1, 4: 0, 9: 0}
    by_intent = {r["call_id"]: r["repeat_count"] for r in repeats.prior_same_intent(df).collect()}
    assert by_intent == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 9: 0}


@pytest.mark.parametrize("block", [1_000_000, 3_600_000_000, 10**14])
def test_counts_equal_brute_force_whatever_the_blocks(spark, block):
    rng = random.Random(3)
    # One customer holds most of the calls.
    rows = [
        (i, rng.choice(["hot"] * 4 + ["a", "b"]), rng.choice(["k", "l"]), "x", T0 + dt.timedelta(hours=rng.randint(0, 2400)))
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["call_id"]: r["repeat_count"] for r in repeats.prior_counts(df, ["customer_id", "cluster_id"], 30, block).collect()}
    month = dt.timedelta(days=30)
    want = {
        a[0]: sum(b[1:3] == a[1:3] and b[4] < a[4] and a[4] - b[4] <= month for b in rows) for a in rows
    }
    assert got == want


def test_no_self_join_in_the_plan(spark):
    df = spark.createDataFrame([(1, "c", "k", "x", T0)], SCHEMA)
    plan = repeats.prior_counts(df, ["customer_id", "cluster_id"], 30)._jdf.queryExecution().optimizedPlan().toString()
    assert "Inner" not in plan and "Cross" not in plan
