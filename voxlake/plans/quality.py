"""Quality reports over stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions import similarity as sim
from voxlake.functions import text as tx
from voxlake.operators.evidence import Support, build_evidence, claim_to_check, judgment_claims, verify


def reverify(evidence: DataFrame, turns: DataFrame, support: Support = Support()) -> DataFrame:
    """Run verification again over stored citations. `orphaned` marks those whose turn is gone or empty."""
    joined = evidence.select(
        "call_id", "claim_type", "claim_text", "turn_index", "quote", F.col("verified").alias("stored")
    ).join(turns.select("call_id", "turn_index", "text"), ["call_id", "turn_index"], "left")
    checked = verify(
        joined.withColumn("claim", claim_to_check(F.col("claim_type"), F.col("claim_text"))).withColumn(
            "_gone", F.coalesce(F.col("text"), F.lit("")) == ""
        ),
        support,
    )
    return checked.withColumnRenamed("_gone", "orphaned")


def pass_rates(checked: DataFrame) -> DataFrame:
    """Pass rate overall (claim type null) and per claim type, in one pass."""
    return (
        checked.where(~F.col("orphaned"))
        .rollup("claim_type")
        .agg(F.count("*").alias("total"), F.count_if("verified").alias("passed"))
        .withColumn("pass_rate", F.col("passed") / F.col("total"))
    )


def rejections(checked: DataFrame) -> DataFrame:
    failed = checked.where(~F.col("orphaned") & ~F.col("verified"))
    return failed.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("reason"))


def first_failures(checked: DataFrame, limit: int = 5) -> DataFrame:
    failed = checked.where(~F.col("orphaned") & ~F.col("verified"))
    return failed.select("call_id", "claim_type", "turn_index", "reason").orderBy(
        "call_id", "claim_type", "turn_index"
    ).limit(limit)


def stored_against_recomputed(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count_if("stored").alias("stored_verified"),
        F.count_if(~F.col("orphaned") & F.col("verified")).alias("recomputed_verified"),
        F.count_if("orphaned").alias("orphaned"),
    )


def claim_coverage(calls: DataFrame, evidence: DataFrame) -> DataFrame:
    """How many analysed calls carry each judgment, and how many have a verified intent citation."""
    cited = evidence.where((F.col("claim_type") == "intent") & F.col("verified")).agg(
        F.count_distinct("call_id")
    )
    return (
        calls.where(F.col("analyzed_at").isNotNull())
        .agg(
            F.count("*").alias("analysed"),
            F.count("intent_label").alias("intents"),
            F.count("resolution_status").alias("resolutions"),
            F.count("mood_shift_turn_index").alias("shifts"),
        )
        .withColumn("verified_intents", F.coalesce(cited.scalar(), F.lit(0)))
    )


def spoken_texts(turns: DataFrame) -> DataFrame:
    """All turns of a call as one text, in order."""
    parts = F.array_sort(F.collect_list(F.struct("turn_index", "text")))
    return turns.groupBy("call_id").agg(F.array_join(parts["text"], " ").alias("hypothesis"))


def word_error_rates(hypotheses: DataFrame, references: DataFrame) -> DataFrame:
    """Per call: word edits against the reference, and the rate. Both texts are lower-cased, whole."""
    ref, hyp = tx.words(F.lower("reference")), tx.words(F.lower("hypothesis"))
    joined = references.join(hypotheses, "call_id").select("call_id", ref.alias("_r"), hyp.alias("_h"))
    # Equal texts need no alignment.
    differs = F.col("_r") != F.col("_h")
    edits = F.when(differs, sim.word_edits(F.when(differs, F.col("_r")), F.when(differs, F.col("_h")))).otherwise(0)
    return joined.select(
        "call_id", F.size("_r").alias("reference_words"), edits.alias("edits")
    ).withColumn("wer", F.col("edits") / F.nullif(F.col("reference_words"), F.lit(0)))


def word_error_kinds(hypotheses: DataFrame, references: DataFrame) -> DataFrame:
    """Per call: substitutions, deletions and insertions of words against the reference, and the words that are right.

    Of the alignments with the fewest edits the one with the most words right counts. A call without one of the texts has
    null counts. The two texts of a call meet in one row; the alignment takes memory for the shorter one.
    """
    ref, hyp = tx.words(F.lower("reference")), tx.words(F.lower("hypothesis"))
    joined = references.join(hypotheses, "call_id").select("call_id", ref.alias("_r"), hyp.alias("_h"))
    differs = F.col("_r") != F.col("_h")
    found = joined.withColumn("_k", sim.word_alignment(F.when(differs, F.col("_r")), F.when(differs, F.col("_h"))))
    kind = lambda name: F.when(differs, F.col(f"_k.{name}")).when(~differs, 0).alias(name)
    counted = found.select("call_id", F.size("_r").alias("reference_words"), kind("substitutions"), kind("deletions"), kind("insertions"))
    return counted.withColumn("correct", F.col("reference_words") - F.col("substitutions") - F.col("deletions"))


def word_error_summary(rates: DataFrame) -> DataFrame:
    return rates.agg(
        F.count("*").alias("calls"),
        F.avg("wer").alias("mean_wer"),
        (F.sum("edits") / F.nullif(F.sum("reference_words"), F.lit(0))).alias("corpus_wer"),
    )


def judge_evidence(judgments: DataFrame, turns: DataFrame, support: Support = Support()) -> DataFrame:
    """Citations of several judges over the same calls, verified in one job. In: judgments with a `judge` column."""
    tagged = judgments.withColumn("call_id", F.struct("judge", "call_id"))
    judges = judgments.select("judge", "call_id").distinct()
    spoken = turns.join(judges, "call_id").withColumn("call_id", F.struct("judge", "call_id"))
    return build_evidence(judgment_claims(tagged), spoken, support).select(
        F.col("call_id.judge").alias("judge"), F.col("call_id.call_id").alias("call_id"), "claim_type", "verified"
    )


def judge_comparison(judgments: DataFrame, errors: DataFrame, turns: DataFrame, support: Support = Support()) -> DataFrame:
    """Per judge: verified intents and resolutions, their mean, summary length, errors, and distance to the best."""
    proven = judge_evidence(judgments, turns, support).groupBy("judge").agg(
        F.count_if((F.col("claim_type") == "intent") & F.col("verified")).alias("_i"),
        F.count_if((F.col("claim_type") == "resolution") & F.col("verified")).alias("_r"),
    )
    base = judgments.groupBy("judge").agg(
        F.count("*").alias("calls"), F.avg(tx.word_count(F.col("summary"))).alias("summary_words")
    )
    failed = errors.groupBy("judge").agg(F.count("*").alias("errors"))
    rated = (
        base.join(proven, "judge", "left")
        .join(failed, "judge", "left")
        .select(
            "judge",
            "calls",
            (F.coalesce("_i", F.lit(0)) / F.col("calls")).alias("intent_rate"),
            (F.coalesce("_r", F.lit(0)) / F.col("calls")).alias("resolution_rate"),
            "summary_words",
            F.coalesce("errors", F.lit(0)).alias("errors"),
        )
        .withColumn("overall", (F.col("intent_rate") + F.col("resolution_rate")) / 2)
    )
    best = rated.agg(F.max("overall")).scalar()
    return rated.withColumn("behind_best", best - F.col("overall"))


def batch_outcome(ok: DataFrame, errors: DataFrame) -> DataFrame:
    return ok.select(F.lit("ok").alias("outcome")).unionByName(errors.select(F.lit("failed").alias("outcome"))).groupBy(
        "outcome"
    ).agg(F.count("*").alias("calls"))
