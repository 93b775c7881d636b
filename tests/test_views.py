from voxlake.plans import views

CITED = "turn_index int, timestamp string, quote string, verified boolean"


def test_call_detail_gives_factors_with_their_citations(spark):
    calls = spark.createDataFrame([(1, 10, 20), (2, 10, 20), (3, 11, 20)], "call_id long, customer_id long, agent_id long")
    customers = spark.createDataFrame([(10, "Ann"), (11, "Bo")], "customer_id long, name string")
    agents = spark.createDataFrame([(20, "Cy")], "agent_id long, name string")
    evidence = spark.createDataFrame(
        [(1, "intent", 3, 0, "0:03", "a b c d e", True), (1, "attention_factor", 5, 5, "0:09", "f g h i j", False)],
        "call_id long, claim_type string, turn_index int, ord int, timestamp string, quote string, verified boolean",
    )
    attention = spark.createDataFrame(
        [(1, [("mood", 0.4, 5, "d", True, (5, "0:09", "f g h i j", False)), ("repeats", 0.2, None, "d", False, None)]), (2, [])],
        f"call_id long, factors array<struct<factor string, weight double, turn_index int, detail string, check_support boolean, evidence struct<{CITED}>>>",
    )
    got = {r.call_id: r for r in views.call_detail(calls, customers, agents, evidence, attention=attention).collect()}
    assert [(f.factor, f.weight, f.evidence and tuple(f.evidence)) for f in got[1].attention_factors] == [
        ("mood", 0.4, (5, "0:09", "f g h i j", False)),
        ("repeats", 0.2, None),
    ]
    assert got[2].attention_factors == [] == got[3].attention_factors
    assert got[1].evidence_coverage == 50.0 and got[3].evidence_coverage is None
    one = views.call_detail(calls, customers, agents, evidence, 1, attention).collect()
    assert one == [got[1]] and one[0].intent_evidence.quote == "a b c d e"
