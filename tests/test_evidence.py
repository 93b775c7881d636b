import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxlake import fixed
from voxlake.functions import similarity as sim
from voxlake.functions.text import normalise
from voxlake.operators import contradiction, evidence

rng = random.Random(21)
VOCABULARY = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(300)]


def words(n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=14), st.text("abc ", max_size=14))
def test_common_length_equals_the_plain_recurrence(a, b):
    assert sim._common(a, b) == lcs(a, b)


@settings(max_examples=100, deadline=None)
@given(st.text("ab ", min_size=1, max_size=6), st.text("ab ", min_size=1, max_size=12))
def test_best_span_equals_trying_every_window(a, b):
    want = 0.0
    for short, long in ((a, b), (b, a)):
        if len(short) <= len(long):
            windows = {long[i: i + len(short)] for i in range(len(long) - len(short) + 1)}
            windows |= {long[:k] for k in range(1, len(short))} | {long[-k:] for k in range(1, len(short))}
            want = max([want, *(200 * lcs(short, x) / (len(short) + len(x)) for x in windows)])
    assert sim._best_span(a, b)[0] == pytest.approx(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("xyz"), max_size=8), st.lists(st.sampled_from("xyz"), max_size=8))
def test_word_edits_equals_the_plain_recurrence(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    assert sim._edits(a, b) == row[-1]


def test_span_checks_of_generated_quotes(spark):
    rows, want = [], {}
    for i in range(80):
        turn = words(rng.randint(14, 40))
        n = rng.randint(2, 12)
        at = rng.randint(0, len(turn) - n)
        quote = turn[at : at + n]
        kind = i % 4
        if kind == 1:
            quote = [w.upper() + "!" for w in quote]
        elif kind == 2:
            quote = ["x" * len(w) for w in quote]
        elif kind == 3 and n > 8:
            quote[4] = "qq"  # one word of many is another one
        rows.append((str(i), " ".join(quote), " ".join(turn), None))
        want[str(i)] = "shorter than" if n < 5 else "does not occur" if kind == 2 else "" if kind < 2 or n > 8 or quote == turn[at : at + n] else None
    got = {r["id"]: r for r in evidence.verify(spark.createDataFrame(rows, "id string, quote string, text string, claim string")).collect()}
    for k, reason in want.items():
        r = got[k]
        assert reason is None or (reason in r["reason"] and r["verified"] == (reason == "") and r["method"] == "none")
        assert int(k) % 4 > 1 or r["match_score"] == (0 if "shorter" in r["reason"] else 100)
    assert {"", "shorter than", "does not occur"} <= set(want.values())


def test_support_needs_the_claims_words(spark):
    rows = []
    for i in range(20):
        turn = words(12)
        rows += [(f"own{i}", " ".join(turn[2:10]), " ".join(turn), " ".join(turn[3:9])), (f"else{i}", " ".join(turn[2:10]), " ".join(turn), " ".join("z" * len(w) for w in turn[3:9]))]
    for r in evidence.verify(spark.createDataFrame(rows, "id string, quote string, text string, claim string")).collect():
        own = r["id"].startswith("own")
        assert r["verified"] == own and r["method"] == "lexical" and (r["support_score"] > 45) == own
        assert own or "does not support" in r["reason"]


def test_a_quote_is_the_sentence_nearest_to_the_claim(spark):
    rows = []
    for i in range(30):
        sentences = [" ".join(words(rng.randint(5, 9))).capitalize() + "." for _ in range(4)]
        chosen = sentences[i % 4]
        rows.append((" ".join(sentences), chosen.lower().rstrip("."), chosen))
    rows += [("", "x", ""), ("Nur ein kurzer Satz", "kurz", "Nur ein kurzer Satz")]
    df = spark.createDataFrame(rows, "text string, claim_text string, want string")
    got = evidence.select_quotes(df).withColumn("inside", F.contains(normalise(F.col("text")), normalise(F.col("quote")))).collect()
    assert all(r["inside"] and r["quote"] == r["want"] for r in got)


def test_vector_support_uses_the_callers_embedding(spark):
    import pandas as pd
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda ts: None if ts is None else [[1.0, float("card" in (t or "")), 0.2] for t in ts])

    df = spark.createDataFrame(
        [("I lost my card at the shop", "I lost my card at the shop", "card"), ("I like the weather a lot", "I like the weather a lot", "card card")],
        "quote string, text string, claim string",
    )
    got = {r["claim"]: r for r in evidence.verify(df, evidence.Support("embedding", embed)).collect()}
    assert got["card"]["verified"] and got["card"]["method"] == "embedding" and got["card"]["support_score"] == pytest.approx(100)
    assert got["card card"]["support_score"] == pytest.approx(((1.04 / (1.04**0.5 * 2.04**0.5)) - 0.3) / 0.7 * 100)


def test_factor_reuses_the_turns_citation_or_builds_one(spark):
    turns = spark.createDataFrame(
        [("c", 0, 5.0, "I want my card replaced today please"), ("c", 1, 9.0, "this really is the third time I call")],
        "call_id string, turn_index int, start_seconds double, text string",
    )
    claims = spark.createDataFrame(
        [("c", "intent", "card replaced today", 0, 0, True), ("c", "resolution", "other claim", 0, 1, True), ("c", "intent", "out of range", 7, 0, True)],
        "call_id string, claim_type string, claim_text string, turn_index int, ord int, check_support boolean",
    )
    built = evidence.build_evidence(claims, turns)
    assert built.count() == 2
    factor = "array<struct<factor:string,weight:double,turn_index:int,detail:string,check_support:boolean>>"
    scores = spark.createDataFrame(
        [("c", 50, [("issue unresolved", 0.3, 0, "", True), ("escalation", 0.2, 1, "", True), ("long", 0.05, None, "", False)])],
        f"call_id string, attention_score int, factors {factor}",
    )
    cited, every = evidence.cite_factors(scores, built, turns)
    f = cited.first()["factors"]
    assert f[0]["evidence"]["quote"] == "I want my card replaced today please" and f[0]["evidence"]["verified"]
    assert f[1]["evidence"]["timestamp"] == "00:00:09" and f[2]["evidence"] is None
    assert sorted(r["claim_type"] for r in every.collect()) == ["attention_factor", "intent", "resolution"]
    assert '"evidence":null' in evidence.factor_payloads(cited).first()["factors_json"]


def test_contradictions_need_a_later_pushback(spark):
    """Calls of random turns against a plain reading: the first claim of the agent with a pushback of the customer after it."""
    claim, push, other = "the issue is resolved now", "that is still not working here", "mm"
    texts = spark.createDataFrame([(claim,), (push,), (other,)], "t string").select(F.col("t").rlike(fixed.AGENT_CLAIM), F.col("t").rlike(fixed.CUSTOMER_PUSHBACK)).collect()
    assert [tuple(r) for r in texts] == [(True, False), (False, True), (False, False)]
    rows = [(f"c{c:02d}", i, rng.choice(["agent", "customer"]), rng.choice([claim, push, other])) for c in range(60) for i in range(6)]
    t = spark.createDataFrame(rows, "call_id string, turn_index int, speaker string, text string")
    got = {r[0]: tuple(r)[1:] for r in contradiction.contradictions(t).collect()}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        pairs = [(a[1], b[1]) for a in own for b in own if a[2:] == ("agent", claim) and b[2:] == ("customer", push) and b[1] > a[1]]
        assert (c in got) == bool(pairs) and (c not in got or got[c] in pairs)
    assert 10 < len(got) < 60
    judged = spark.createDataFrame([(c, "resolved" if c < "c30" else "partial") for c in got], "call_id string, resolution_status string")
    assert {r["call_id"] for r in contradiction.resolved_contradictions(t, judged).collect()} == {c for c in got if c < "c30"}


def test_turns_do_not_go_through_the_driver(spark):
    said = spark.range(500).select(F.col("id").alias("call_id"), F.lit(0).alias("turn_index"), F.lit("the bill is wrong again").alias("text"), F.lit(1.0).alias("start_seconds"))
    claims = evidence.judgment_claims(said.select("call_id", F.lit("a bill").alias("intent_label"), F.lit("partial").alias("resolution_status"), F.lit(0).alias("intent_turn_index"), F.lit(0).alias("resolution_turn_index")))
    found = evidence.build_evidence(claims, said)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 1000
