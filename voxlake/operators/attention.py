"""The 0-100 attention score: plain arithmetic over stage results, with the factors that fired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake import fixed
from voxlake.functions import text as tx
from voxlake.functions.once import computed_once
from voxlake.functions.scan import exact_median

FACTOR = "struct<factor:string,weight:double,turn_index:int,detail:string,check_support:boolean>"

# Input columns an unset value is filled in for.
OPTIONAL = {
    "worst_mood": "double",
    "worst_mood_turn_index": "int",
    "shift_delta": "double",
    "shift_turn_index": "int",
    "escalation_count": "bigint",
    "escalation_turn_index": "int",
    "escalation_phrase": "string",
    "repeat_count": "int",
    "median_duration": "double",
    "resolution_turn_index": "int",
    "intent_turn_index": "int",
    "contradiction_turn_index": "int",
}


def median_duration(calls: DataFrame) -> DataFrame:
    """One row: the exact median handle time."""
    return exact_median(calls, "duration_seconds", name="median_duration")


def with_median_duration(calls: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """Attach the corpus median as a scalar subquery, so no join is planned. `corpus` has the durations, or one row with
    their `median_duration`."""
    known = corpus is not None and "median_duration" in corpus.columns
    one = corpus.select("median_duration") if known else median_duration(corpus if corpus is not None else calls)
    return calls.withColumn("median_duration", F.coalesce(one.scalar(), F.lit(0.0)))


def _share(value: Column) -> Column:
    return F.least(F.abs(value), F.lit(1.0))


def _factor(fires: Column, name: Column, part: Column, turn: Column, detail: Column, check: bool) -> Column:
    made = F.struct(
        name.alias("factor"),
        F.bround(part, 3).alias("weight"),
        turn.cast("int").alias("turn_index"),
        detail.alias("detail"),
        F.lit(check).alias("check_support"),
    )
    return F.when(fires, made.cast(FACTOR))


def resolution_part(status: Column) -> Column:
    s = F.lower(status)
    severity = F.when(s == "unresolved", 1.0).when(s == "partial", 0.5).when(s == "resolved", 0.0).otherwise(0.5)
    return fixed.WEIGHT_RESOLUTION * severity


def mood_part(worst: Column) -> Column:
    return F.when(worst <= fixed.MOOD_CLAIM_FLOOR, fixed.WEIGHT_MOOD_SEVERITY * _share(worst)).otherwise(0.0)


def shift_part(delta: Column) -> Column:
    return F.when(delta < 0, fixed.WEIGHT_MOOD_SHIFT * _share(delta)).otherwise(0.0)


def escalation_part(hits: Column) -> Column:
    return F.when(hits > 0, fixed.WEIGHT_ESCALATION * F.least(hits / 2.0, F.lit(1.0))).otherwise(0.0)


def repeat_part(earlier: Column) -> Column:
    return F.when(earlier > 0, fixed.WEIGHT_REPEAT * F.least(earlier / 3.0, F.lit(1.0))).otherwise(0.0)


def handle_time_part(duration: Column, median: Column) -> Column:
    ratio = duration / F.nullif(median, F.lit(0.0))
    over = (ratio - fixed.HANDLE_TIME_START) / (fixed.HANDLE_TIME_OUTLIER - fixed.HANDLE_TIME_START)
    return F.when(
        (median > 0) & (ratio > fixed.HANDLE_TIME_START), fixed.WEIGHT_HANDLE_TIME * F.least(over, F.lit(1.0))
    ).otherwise(0.0)


def attention_scores(inputs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """`call_id, attention_score, factors`; factors sorted by weight, ties in the order they are listed here."""
    filled = inputs
    for column, kind in OPTIONAL.items():
        if column not in inputs.columns:
            filled = filled.withColumn(column, F.lit(None).cast(kind))
    c = F.col
    duration = F.coalesce(c("duration_seconds").cast("double"), F.lit(0.0))
    parts = {
        "resolution": resolution_part(c("resolution_status")),
        "mood": mood_part(c("worst_mood")),
        "shift": shift_part(c("shift_delta")),
        "escalation": escalation_part(c("escalation_count")),
        "repeat": repeat_part(c("repeat_count")),
        "handle": handle_time_part(duration, c("median_duration")),
    }
    priced = computed_once(filled, **{f"_{name}": part for name, part in parts.items()})
    total = c("_resolution") + c("_mood") + c("_shift") + c("_escalation") + c("_repeat") + c("_handle")
    base = F.bround(F.least(total, F.lit(1.0)) * 100).cast("int")
    contradicted = c("contradiction_turn_index").isNotNull()
    bonus = round(fixed.WEIGHT_CONTRADICTION * 100)
    score = F.when(contradicted, F.least(F.lit(100), base + bonus)).otherwise(base)
    status = c("resolution_status")
    none = F.lit(None).cast("int")
    factors = F.array(
        _factor(
            c("_resolution") > 0,
            F.concat(F.lit("issue "), F.coalesce(F.nullif(status, F.lit("")), F.lit("unknown"))),
            c("_resolution"),
            c("resolution_turn_index"),
            F.concat(F.lit(fixed.DETAIL_RESOLUTION), F.coalesce(status, F.lit("None"))),
            True,
        ),
        _factor(
            c("_mood") > 0,
            F.lit(fixed.FACTOR_MOOD),
            c("_mood"),
            c("worst_mood_turn_index"),
            F.format_string(fixed.DETAIL_MOOD, c("worst_mood")),
            False,
        ),
        _factor(
            c("_shift") > 0,
            F.lit(fixed.FACTOR_SHIFT),
            c("_shift"),
            c("shift_turn_index"),
            F.format_string(fixed.DETAIL_SHIFT, F.abs(c("shift_delta"))),
            False,
        ),
        _factor(
            c("_escalation") > 0,
            F.concat(F.lit('escalation language: "'), c("escalation_phrase"), F.lit('"')),
            c("_escalation"),
            c("escalation_turn_index"),
            F.format_string(fixed.DETAIL_ESCALATION, c("escalation_count")),
            True,
        ),
        _factor(
            c("_repeat") > 0,
            F.concat(tx.ordinal(c("repeat_count") + 1), F.lit(" call about this issue")),
            c("_repeat"),
            c("intent_turn_index"),
            F.format_string(fixed.DETAIL_REPEAT, c("repeat_count")),
            False,
        ),
        _factor(
            c("_handle") > 0,
            F.lit(fixed.FACTOR_LONG),
            c("_handle"),
            none,
            F.format_string(fixed.DETAIL_HANDLE_TIME, duration / c("median_duration")),
            False,
        ),
        _factor(
            contradicted,
            F.lit(fixed.FACTOR_CONTRADICTION),
            F.lit(fixed.WEIGHT_CONTRADICTION),
            c("contradiction_turn_index"),
            F.lit(fixed.DETAIL_CONTRADICTION),
            False,
        ),
    )
    ranked = F.array_sort(
        F.transform(
            F.array_compact(factors),
            lambda f, i: F.struct((-f["weight"]).alias("down"), i.alias("place"), f.alias("f")),
        )
    )
    return priced.select(
        "call_id", *keep, score.alias("attention_score"), F.transform(ranked, lambda r: r["f"]).alias("factors")
    )


def attention_band(score: Column) -> Column:
    return F.when(score.isNull(), "none").when(score >= 75, "critical").when(score >= 50, "flagged").otherwise("low")


def rescore_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Old against new scores: calls, factors, cited factors, changed scores. Writes nothing."""
    old = before.select("call_id", F.col("attention_score").alias("_old"))
    joined = after.join(old, "call_id", "left")
    return joined.agg(
        F.count("*").alias("calls"),
        F.sum(F.size("factors")).alias("factors"),
        F.sum(F.size(F.filter("factors", lambda f: f["turn_index"].isNotNull()))).alias("factors_cited"),
        F.count_if(~F.col("attention_score").eqNullSafe(F.col("_old"))).alias("scores_changed"),
    )
