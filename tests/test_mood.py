import pytest
from pyspark.sql import functions as F

from voxlake import fixed, schemas
from voxlake.operators import mood

TURNS = f"call_id string, turn_index int, speaker string, start_seconds double, end_seconds double, text string, words array<{schemas.WORD}>"


def turns(spark, *rows):
    return spark.createDataFrame([(c, i, s, a, b, t, ws) for c, i, s, a, b, t, ws in rows], TURNS)


def customer(spark, *texts):
    return turns(spark, *[("c", i, "customer", 0.0, 5.0, t, []) for i, t in enumerate(texts)])


def valence(spark, *texts):
    rows = mood.text_valence(customer(spark, *texts), mood.default_lexicon(spark)).orderBy("turn_index").collect()
    return [(r["valence"], r["mere_decline"]) for r in rows]


def test_each_word_of_the_lexicon_has_its_sign(spark):
    words = [(r["token"], r["valence"]) for r in mood.default_lexicon(spark).collect() if r["token"].isalpha() and r["token"] not in fixed.REFUSAL_WORDS]
    got = valence(spark, *[f"the parcel looks {w} from here" for w, _ in words])
    assert len(words) > 30 and all(v * x > 0 for (v, _), (_, x) in zip(got, words) if abs(x) > 0.5)


def test_rules_around_a_word(spark):
    lexicon = {r["token"]: r["valence"] for r in mood.default_lexicon(spark).collect()}
    for w in sorted(w for w, x in lexicon.items() if w.isalpha() and x > 1.5)[:6]:
        forms = [f"seats look {w}", f"seats look {fixed.BOOST_UP[0]} {w}", f"seats look {w}!!!", f"seats look {w.upper()}", f"seats do not look {w}", "", "\t"]
        plain, boosted, loud, caps, negated, *empty = [v for v, _ in valence(spark, *forms)]
        assert 0 < plain < min(boosted, loud, caps) and negated < 0 and empty == [0.0, 0.0]


def test_refusals_are_no_complaints(spark):
    refusals = [f"{w}{tail}" for w in ("no", "nope", "nah") for tail in (", thanks", " thank you", "")]
    lexicon = {r["token"]: r["valence"] for r in mood.default_lexicon(spark).collect()}
    harsh = sorted(w for w, x in lexicon.items() if w.isalpha() and x < -1.5 and w not in fixed.REFUSAL_WORDS)[:8]
    assert all(d for _, d in valence(spark, *refusals))
    assert not any(d for _, d in valence(spark, *[f"no, the route was {w} again" for w in harsh]))


def test_delivery_against_own_median(spark):
    word = lambda i, step: (f"w{i}", i * step, i * step + 0.1, 1.0)
    rows = [
        ("c", 0, "customer", 0.0, 4.0, "x", [word(i, 0.5) for i in range(8)]),
        ("c", 1, "customer", 0.0, 2.0, "x", [word(i, 0.25) for i in range(8)]),
        ("c", 2, "customer", 0.0, 4.0, "x", [word(i, 0.5) for i in range(8)]),
        ("c", 3, "customer", 0.0, 0.3, "Oh,", [word(0, 0.5)]),
        ("c", 4, "agent", 0.0, 0.3, "angry terrible", []),
    ]
    p = {r["turn_index"]: r for r in mood.mood_points(turns(spark, *rows), mood.default_lexicon(spark)).collect()}
    assert set(p) == {0, 1, 2, 3}
    assert p[0]["prosody_score"] == p[2]["prosody_score"] == 0.0 and p[1]["prosody_score"] == pytest.approx(-0.6)
    assert p[3]["prosody_score"] == 0.0


def test_pauses_read_negative_and_scores_stay_bounded(spark):
    one = spark.range(1).select(
        mood.prosody_valence(F.lit(2.0), F.lit(2.0), F.lit(0.6), F.lit(True)).alias("slow"),
        mood.prosody_valence(F.lit(2.0), F.lit(2.0), F.lit(0.0), F.lit(True)).alias("even"),
        mood.prosody_valence(F.lit(90.0), F.lit(2.0), F.lit(0.0), F.lit(True)).alias("fast"),
        mood.fused_score(F.lit(-1.0), F.lit(-1.0)).alias("low"),
        mood.fused_score(F.lit(1.0), F.lit(1.0)).alias("high"),
    ).first()
    assert one["slow"] < one["even"] and one["fast"] == -1.0 and one["low"] == -1.0 and one["high"] == 1.0


def test_escalation_is_cited_by_turn_and_customer_only(spark):
    phrases = list(fixed.ESCALATION_PHRASES)
    rows = [("c", 2 * i, "customer", 0.0, 1.0, f"well {p.upper()} then", []) for i, p in enumerate(phrases)]
    rows += [("c", 2 * i + 1, "agent", 0.0, 1.0, f"well {p} then", []) for i, p in enumerate(phrases)]
    hits = mood.escalation_hits(turns(spark, *rows))
    found = {(r["turn_index"], r["phrase"]) for r in hits.collect()}
    assert {(2 * i, p) for i, p in enumerate(phrases)} <= found and all(i % 2 == 0 and p in phrases[i // 2] for i, p in found)
    s = mood.escalation_summary(hits).first()
    assert (s["escalation_count"], s["escalation_turn_index"], s["escalation_phrase"]) == (hits.count(), 0, phrases[0])


def test_no_customer_turns_give_no_points(spark):
    t = turns(spark, ("c", 0, "agent", 0.0, 1.0, "Hello?", []))
    assert mood.mood_points(t, mood.default_lexicon(spark)).count() == 0


def test_substantive_turns(spark):
    from voxlake.functions.text import is_substantive

    texts = ["Thank you so much.", "bye", "70021.", "$147", "my card", "I lost my debit card yesterday", "No, have a nice day"]
    got = customer(spark, *texts).orderBy("turn_index").select(is_substantive(F.col("text"))).collect()
    assert [r[0] for r in got] == [False, False, False, False, False, True, False]


def test_no_words_go_through_the_driver(spark):
    said = spark.range(1000).select(F.col("id").alias("call_id"), F.lit(0).alias("turn_index"), F.lit("so good and so bad").alias("text"))
    scored = mood.text_valence(said, mood.default_lexicon(spark))
    assert "BuildLeft" not in scored._jdf.queryExecution().executedPlan().toString()
    assert scored.select("valence").distinct().count() == 1
