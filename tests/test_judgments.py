from pyspark.sql import functions as F

from voxlake.operators import judgments as ops

GOOD = '{"intent":{"label":"replace card","turn_id":1},"resolution":{"status":"Resolved","turn_id":2},"summary":"done"}'
RAW = {
    "plain": GOOD,
    "stray": "{\n " + GOOD,
    "fenced": "Sure:\n```json\n" + GOOD + "\n```",
    "empty_first": "{} " + GOOD,
    "text_id": GOOD.replace('"turn_id":1', '"turn_id":"7"'),
    "negative": GOOD.replace('"turn_id":1', '"turn_id":-1'),
    "huge": GOOD.replace('"turn_id":1', '"turn_id":999'),
    "word_id": GOOD.replace('"turn_id":1', '"turn_id":"first"'),
    "bad_status": GOOD.replace("Resolved", "solved"),
    "blank": GOOD.replace("replace card", "  "),
    "other_keys": '{"answer": 1}',
    "nothing": "{}",
    "decimal_text": GOOD.replace('"turn_id":1', '"turn_id":"2.9"'),
    "decimal": GOOD.replace('"turn_id":1', '"turn_id":2.9'),
    "truth": GOOD.replace('"turn_id":1', '"turn_id":true'),
    "list": "[" + GOOD + "]",
    "none": "I cannot help",
    "broken": '{"intent": {"label": "x"',
}


def test_tolerant_parsing_and_coercion(spark):
    raw = spark.createDataFrame(list(RAW.items()), "call_id string, payload string")
    parsed = ops.parse_payloads(raw)
    bad = {r["call_id"] for r in parsed.where(F.col("error").isNotNull()).collect()}
    assert bad == {"none", "broken", "list"}
    counts = raw.select("call_id", F.lit(5).cast("bigint").alias("n_turns"))
    got = {r["call_id"]: r for r in ops.coerce(parsed.where(F.col("error").isNull()), counts).collect()}
    for key in ("plain", "stray", "fenced", "empty_first"):
        r = got[key]
        assert (r["intent_label"], r["intent_turn_index"], r["resolution_status"], r["resolution_turn_index"], r["summary"]) == (
            "replace card", 1, "resolved", 2, "done")
    ids = {k: got[k]["intent_turn_index"] for k in ("text_id", "negative", "huge", "word_id")}
    assert ids == {"text_id": 4, "negative": 0, "huge": 4, "word_id": 0}
    assert [got[k]["intent_turn_index"] for k in ("decimal_text", "decimal", "truth")] == [0, 2, 1]
    assert (got["nothing"]["intent_label"], got["nothing"]["resolution_status"]) == ("unclear", "unresolved")
    assert got["bad_status"]["resolution_status"] == "unresolved" and got["blank"]["intent_label"] == "unclear"
    assert got["other_keys"]["intent_label"] == "unclear" and got["other_keys"]["resolution_turn_index"] == 0


def test_summary_clamp(spark):
    df = spark.createDataFrame([(" ".join(["w"] * 39 + ["end,"] + ["more"]),), ("  short one ",)], "s string")
    a, b = [r[0] for r in df.select(ops.clamp_summary(F.col("s"))).collect()]
    assert a.endswith("end…") and len(a.split()) == 40 and b == "short one"


def test_model_judge_reads_whole_calls_and_isolates_errors(spark):
    import pandas as pd
    from pyspark.sql import types as T

    @F.pandas_udf(T.StringType())
    def model(text: pd.Series) -> pd.Series:
        return text.map(lambda t: GOOD if "[2600] 43:20 customer: the card" in t and t.startswith("[0] ") and "[4999] " in t else "no idea")

    rows = [("long", i, "customer", float(i), "the card" if i == 2600 else "go on") for i in range(5000)] + [("short", 0, "customer", 0.0, "hello")]
    t = spark.createDataFrame(rows, "call_id string, turn_index int, speaker string, start_seconds double, text string")
    judged, errors = ops.attach_judgments(t, ops.model_judge(model))
    assert [(r["call_id"], r["intent_turn_index"], r["resolution_turn_index"]) for r in judged.collect()] == [("long", 1, 2)]
    assert [r["call_id"] for r in errors.collect()] == ["short"]
