import pytest
from pyspark.sql import functions as F

from voxlake.operators import attention

BASE = dict(resolution_status="resolved", worst_mood=0.0, duration_seconds=60.0, median_duration=60.0)
CASES = {
    "clean": {},
    "unresolved": dict(resolution_status="unresolved", resolution_turn_index=12),
    "partial": dict(resolution_status="partial"),
    "no_status": dict(resolution_status=None),
    "happy": dict(worst_mood=0.8),
    "improving": dict(shift_delta=0.6),
    "worsening": dict(shift_delta=-0.6, shift_turn_index=9),
    "one_phrase": dict(escalation_count=1, escalation_phrase="supervisor", escalation_turn_index=7),
    "four_phrases": dict(escalation_count=4, escalation_phrase="supervisor", escalation_turn_index=3),
    "worst": dict(resolution_status="unresolved", worst_mood=-1.0, shift_delta=-1.0, escalation_count=2, escalation_phrase="lawsuit",
                  escalation_turn_index=1, duration_seconds=300.0, repeat_count=5, contradiction_turn_index=4),
    "below_minus_one": dict(resolution_status="unresolved", worst_mood=-5.0),
    "mild": dict(worst_mood=-0.10),
    "bad": dict(worst_mood=-0.55, worst_mood_turn_index=4),
    "floor": dict(resolution_status="unresolved", worst_mood=-0.2),
    "long": dict(duration_seconds=300.0),
    "repeat": dict(repeat_count=2, intent_turn_index=1),
    "contradicted": dict(contradiction_turn_index=5),
}


@pytest.fixture(scope="module")
def scored(spark):
    kinds = {**attention.OPTIONAL, "resolution_status": "string", "duration_seconds": "double"}
    schema = "call_id string, " + ", ".join(f"{k} {v}" for k, v in kinds.items())
    rows = [(name, *[{**BASE, **case}.get(k) for k in kinds]) for name, case in CASES.items()]
    got = attention.attention_scores(spark.createDataFrame(rows, schema)).collect()
    return {r["call_id"]: r for r in got}


def names(row):
    return [f["factor"] for f in row["factors"]]


def test_scores(scored):
    s = {k: r["attention_score"] for k, r in scored.items()}
    assert s["clean"] == s["happy"] == s["improving"] == s["mild"] == 0
    assert s["unresolved"] == 30 and s["partial"] == s["no_status"] == 15
    assert s["worsening"] == 9 and s["one_phrase"] == 10 and s["four_phrases"] == 20
    assert s["worst"] == 100 and all(0 <= v <= 100 for v in s.values())
    assert s["contradicted"] == 20 and s["repeat"] == 7


def test_factors_are_sorted_and_only_those_that_fired(scored):
    for row in scored.values():
        weights = [f["weight"] for f in row["factors"]]
        assert weights == sorted(weights, reverse=True) and all(w > 0 for w in weights)
    assert scored["clean"]["factors"] == [] and names(scored["no_status"]) == ["issue unknown"]
    assert names(scored["floor"]) == ["issue unresolved", "lowest customer mood"]
    # Equal weights keep the order of definition, the contradiction last.
    assert names(scored["worst"])[:4] == [
        "issue unresolved", "lowest customer mood", 'escalation language: "lawsuit"', 'customer\'s later words contradict the agent\'s "resolved" claim',
    ]


def test_factors_cite_turns(scored):
    only = lambda key: scored[key]["factors"][0]
    assert only("unresolved")["turn_index"] == 12 and only("partial")["turn_index"] is None
    assert only("one_phrase")["turn_index"] == 7 and only("bad")["turn_index"] == 4 and not only("bad")["check_support"]
    assert only("worsening")["turn_index"] == 9 and only("long")["turn_index"] is None
    assert only("repeat")["factor"] == "3rd call about this issue" and only("repeat")["detail"] == "2 earlier call(s) about this issue"


def test_each_factor_only_raises_the_score(spark):
    steps = spark.range(0, 101).select((F.col("id") / 50.0 - 1).alias("x"))
    got = steps.select("x", attention.mood_part(F.col("x")).alias("m"), attention.shift_part(F.col("x")).alias("s")).orderBy("x").collect()
    for a, b in zip(got, got[1:]):
        assert a["m"] >= b["m"] >= 0 and a["s"] >= b["s"] >= 0


def test_median_is_exact(spark):
    for values in ([3.0], [1.0, 2.0], [5.0, 1.0, 9.0], [2.0] * 7 + [100.0], [float(i % 37) for i in range(5000)]):
        df = spark.createDataFrame([(v,) for v in values], "duration_seconds double")
        ordered = sorted(values)
        mid = len(ordered) // 2
        want = ordered[mid] if len(ordered) % 2 else (ordered[mid - 1] + ordered[mid]) / 2
        assert attention.median_duration(df).first()[0] == want
