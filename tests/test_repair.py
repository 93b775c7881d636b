import datetime as dt

from pyspark.sql import functions as F

from voxlake import schemas
from voxlake.operators import mood
from voxlake.plans.analysis import repair_channel_swaps

SAID = ["hello this is the opening script", "I lost my debit card yesterday", "you're all set now", "thank you"]
START = dt.datetime(2020, 1, 1)


def tables(spark, first):
    """Two calls of four turns; `first` speaks the opening of call b, the agent that of call a."""
    calls = spark.createDataFrame([(c, "ann", START + dt.timedelta(hours=k), 60.0, "card", "resolved", 70) for k, c in enumerate("ab")],
        "call_id string, customer_id string, started_at timestamp, duration_seconds double, intent_label string, resolution_status string, attention_score int")
    other = {"agent": "customer", "customer": "agent"}
    rows = [(c, i, s if i % 2 == 0 else other[s], 5.0 * i, 5.0 * i + 4, t, [], False) for c, s in (("a", "agent"), ("b", first)) for i, t in enumerate(SAID)]
    cited = spark.createDataFrame([("a", "intent"), ("b", "intent"), ("b", "resolution")], "call_id string, claim_type string")
    return calls, spark.createDataFrame(rows, schemas.TURNS), cited, spark.createDataFrame([("a", "k"), ("b", "k")], "call_id string, cluster_id string")


def test_swapped_calls_are_turned_round_forgotten_and_analysed_again(spark):
    calls, turns, cited, bridge = tables(spark, "customer")
    done = repair_channel_swaps(calls, turns, cited, bridge, "opening script", mood.default_lexicon(spark))
    assert [r[0] for r in done.swapped.collect()] == ["b"]
    first = {r["call_id"]: r["speaker"] for r in done.turns.where("turn_index = 0").collect()}
    assert first == {"a": "agent", "b": "agent"} and done.turns.columns == turns.columns
    assert {r["call_id"]: r["intent_label"] for r in done.calls.collect()} == {"a": "card", "b": None}
    assert [r["call_id"] for r in done.evidence.collect()] == ["a"] == [r["call_id"] for r in done.call_clusters.collect()]
    assert [r["call_id"] for r in done.analysis.attention.collect()] == ["b"] == [r["call_id"] for r in done.analysis.judged.collect()]
    assert {r["turn_index"] for r in done.analysis.points.collect()} <= {1, 3}


def test_without_a_swap_nothing_changes(spark):
    calls, turns, cited, bridge = tables(spark, "agent")
    done = repair_channel_swaps(calls, turns, cited, bridge, "opening script")
    assert done.analysis is None and done.swapped.count() == 0
    for before, after in ((calls, done.calls), (turns, done.turns), (cited, done.evidence), (bridge, done.call_clusters)):
        assert before.exceptAll(after).count() == 0 == after.exceptAll(before).count()
