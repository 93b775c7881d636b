"""The whole analysis as one plan: turns, mood, judgments, evidence, clusters, score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake import fixed
from voxlake.operators import attention, changepoint, contradiction, evidence, issues, judgments, mood, repeats
from voxlake.operators.evidence import Support
from voxlake.operators.turns import flip_speakers, swapped_calls
from voxlake.session import settle
from voxlake.sources.tables import invalidate

Stage = Callable[[str, DataFrame], DataFrame]


def checkpointed(name: str, df: DataFrame) -> DataFrame:
    """A reliable checkpoint. Its size is a guess, often far too low, so joins merge it and never send it through the driver."""
    return settle(df).hint("merge")


@dataclass(frozen=True)
class Analysis:
    points: DataFrame
    shifts: DataFrame
    judged: DataFrame
    errors: DataFrame
    evidence: DataFrame
    attention: DataFrame


def attention_inputs(
    calls: DataFrame, judged: DataFrame, points: DataFrame, shifts: DataFrame, turns: DataFrame, repeat_counts: DataFrame,
    contradicted: DataFrame, corpus: DataFrame | None = None,
) -> DataFrame:
    """One row per judged call with everything the score needs; every side is one row per call."""
    shift = shifts.select("call_id", F.col("delta").alias("shift_delta"), F.col("turn_index").alias("shift_turn_index"))
    against = contradicted.select("call_id", F.col("customer_turn_index").alias("contradiction_turn_index"))
    timed = attention.with_median_duration(calls.select("call_id", "duration_seconds"), corpus)
    return (
        judged.join(timed.hint("merge"), "call_id")
        .join(mood.worst_mood(points).hint("merge"), "call_id", "left")
        .join(shift.hint("merge"), "call_id", "left")
        .join(mood.escalation_summary(mood.escalation_hits(turns)).hint("merge"), "call_id", "left")
        .join(repeat_counts.hint("merge"), "call_id", "left")
        .join(against.hint("merge"), "call_id", "left")
    )


def analyse(
    calls: DataFrame,
    turns: DataFrame,
    lexicon: DataFrame,
    judge: Any = judgments.rule_judge,
    call_clusters: DataFrame | None = None,
    support: Support = Support(),
    history: DataFrame | None = None,
    corpus: DataFrame | None = None,
    stage: Stage = checkpointed,
) -> Analysis:
    """Analyse calls from their turns.

    Every stage result that is used more than once goes through `stage`: a reliable checkpoint, or a stage table
    (`sources.tables.table_stage`).

    Repeat contact is by issue cluster inside 30 days when `call_clusters` is given, else by intent against `history`
    (earlier judged calls) and the calls themselves, as for calls that arrive before clusters exist.
    """
    points = stage("mood_points", mood.mood_points(turns, lexicon))
    shifts = stage("mood_shifts", changepoint.reportable_shifts(points))
    judged, errors = judgments.attach_judgments(turns, judge)
    judged, errors = stage("judgments", judged), stage("judgment_errors", errors)
    against = stage("contradictions", contradiction.resolved_contradictions(turns, judged))
    claims = (
        evidence.judgment_claims(judged)
        .unionByName(evidence.shift_claims(shifts))
        .unionByName(evidence.contradiction_claims(against))
    )
    cited = stage("claim_evidence", evidence.build_evidence(claims, turns, support))
    if call_clusters is not None:
        earlier = repeats.prior_same_cluster(calls, call_clusters)
    else:
        now = calls.select("call_id", "customer_id", "started_at").join(judged.select("call_id", "intent_label"), "call_id")
        earlier = repeats.prior_same_intent(now if history is None else now.unionByName(history.select(*now.columns)))
    inputs = attention_inputs(calls, judged, points, shifts, turns, earlier, against, corpus)
    scored = stage("scores", attention.attention_scores(inputs))
    with_citations, every = evidence.cite_factors(scored, cited, turns, support)
    every = stage("evidence", every)
    with_citations = stage("attention", with_citations)
    return Analysis(points, shifts, judged, errors, every, with_citations)


def rescore(
    calls: DataFrame,
    turns: DataFrame,
    points: DataFrame,
    stored: DataFrame,
    call_clusters: DataFrame | None,
    support: Support = Support(),
    stage: Stage = checkpointed,
    earlier: DataFrame | None = None,
    corpus: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """`(attention, evidence)` again from stage tables, without a new judgment.

    `calls` are judged calls; `stored` is their evidence. Shift and factor citations are rebuilt, the others reused.
    `earlier` gives repeat counts that are known already, `corpus` what the median handle time comes from.
    """
    shifts = stage("mood_shifts", changepoint.reportable_shifts(points))
    kept = stored.where(~F.col("claim_type").isin("mood_shift", "attention_factor"))
    rebuilt = stage(
        "claim_evidence", kept.unionByName(evidence.build_evidence(evidence.shift_claims(shifts), turns, support))
    )
    where = evidence.cited_turns(kept)
    judged = calls.where(F.col("resolution_status").isNotNull()).select("call_id", "resolution_status").join(
        where.drop("contradiction_turn_index").hint("merge"), "call_id", "left"
    )
    against = where.where(F.col("contradiction_turn_index").isNotNull()).select(
        "call_id", F.col("contradiction_turn_index").alias("customer_turn_index")
    )
    if earlier is None:
        earlier = repeats.prior_same_cluster(calls, call_clusters)
    inputs = attention_inputs(calls, judged, points, shifts, turns, earlier, against, corpus)
    return evidence.cite_factors(stage("scores", attention.attention_scores(inputs)), rebuilt, turns, support)


@dataclass(frozen=True)
class Batch:
    analysis: Analysis
    call_clusters: DataFrame
    names: DataFrame
    attention: DataFrame
    evidence: DataFrame


def analyse_cluster_rescore(
    calls: DataFrame, turns: DataFrame, lexicon: DataFrame, judge: Any = judgments.rule_judge, support: Support = Support(), stage: Stage = checkpointed,
) -> Batch:
    """The batch job: analyse all calls, group them into named issues by what they were about, and score them again with
    repeat contact by issue."""
    done = analyse(calls, turns, lexicon, judge, support=support, stage=stage)
    texts = stage("issue_texts", issues.cluster_texts(done.judged.withColumn("analyzed_at", F.current_timestamp())))
    labels = stage("call_clusters", issues.text_clusters(issues.text_vectors(texts)))
    names = stage("issues", issues.name_clusters(labels.join(texts.withColumnRenamed("call_id", "id"), "id")))
    clusters = labels.select(F.col("id").alias("call_id"), "cluster_id")
    judged = calls.join(done.judged.select("call_id", "resolution_status"), "call_id")
    again, every = rescore(judged, turns, done.points, done.evidence, clusters, support, stage)
    return Batch(done, clusters, names, stage("rescored_attention", again), stage("rescored_evidence", every))


@dataclass(frozen=True)
class Repair:
    """The stage tables after a repair, the calls it touched, and their new analysis where one was asked for."""

    calls: DataFrame
    turns: DataFrame
    evidence: DataFrame
    call_clusters: DataFrame
    swapped: DataFrame
    analysis: Analysis | None


def repair_channel_swaps(
    calls: DataFrame,
    turns: DataFrame,
    evidence_rows: DataFrame,
    call_clusters: DataFrame,
    pattern: str = fixed.GREETING,
    lexicon: DataFrame | None = None,
    judge: Any = judgments.rule_judge,
    support: Support = Support(),
    stage: Stage = checkpointed,
) -> Repair:
    """Find calls whose channels were swapped, turn their speakers round, forget what was judged of them, and with a
    `lexicon` analyse just these calls again.

    The calls are found once, from their first turns. Repeat contact of the new analysis counts all judged calls, the median
    handle time is that of all calls. Without a swapped call everything stays as it is and the analysis is empty.
    """
    swapped = stage("swapped_calls", swapped_calls(turns, pattern))
    flipped = flip_speakers(turns, swapped)
    cleared, kept, bridge = invalidate(calls, evidence_rows, call_clusters, swapped)
    done = None
    if lexicon is not None:
        again = stage("swapped_turns", flipped.join(swapped, "call_id", "left_semi"))
        judged = cleared.where(F.col("intent_label").isNotNull()) if "intent_label" in cleared.columns else None
        done = analyse(
            cleared.join(swapped, "call_id", "left_semi"), again, lexicon, judge, support=support, history=judged,
            corpus=calls.select("duration_seconds"), stage=stage,
        )
    return Repair(cleared, flipped, kept, bridge, swapped, done)
