"""Mood of customer turns: words, delivery, and phrases that escalate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake import fixed
from voxlake.functions import text as tx
from voxlake.functions.once import computed_once
from voxlake.functions.scan import exact_median

EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def default_lexicon(spark) -> DataFrame:
    return spark.createDataFrame(list(fixed.DEFAULT_LEXICON), "token string, valence double")


def _isin(col: Column, values: Sequence[str]) -> Column:
    return F.coalesce(col.isin(list(values)), F.lit(False))


def refusal_free(text: Column) -> Column:
    """The words of a text without plain refusals."""
    return F.filter(
        tx.words(text),
        lambda w: ~F.lower(F.regexp_replace(w, "^[.,!?'\"]+|[.,!?'\"]+$", "")).isin(list(fixed.REFUSAL_WORDS)),
    )


def _token_contexts(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per word: itself, its three predecessors, its place relative to 'but', whether it is shouted.

    In: keys, `variant`, `_w` (words). Built in steps so that each array is computed once per row.
    """
    stepped = computed_once(
        texts,
        _bare=F.transform("_w", lambda w: F.regexp_replace(F.lower(w), EDGE, "")),
        _loud=F.transform("_w", lambda w: (F.upper(w) == w) & (F.lower(w) != w)),
    )
    stepped = computed_once(
        stepped,
        _but=F.array_position("_bare", "but"),
        _mixed=F.exists("_loud", lambda s: s) & ~F.forall("_loud", lambda s: s),
    )

    def context(token: Column, i: Column) -> Column:
        return F.struct(
            token.alias("token"),
            F.when(i >= 1, F.get("_bare", i - 1)).alias("p1"),
            F.when(i >= 2, F.get("_bare", i - 2)).alias("p2"),
            F.when(i >= 3, F.get("_bare", i - 3)).alias("p3"),
            F.when(F.col("_but") == 0, 1.0)
            .when(i + 1 < F.col("_but"), fixed.BUT_BEFORE)
            .when(i + 1 > F.col("_but"), fixed.BUT_AFTER)
            .otherwise(1.0)
            .alias("weight"),
            (F.col("_mixed") & F.get("_loud", i)).alias("shout"),
        )

    return stepped.select(*keys, "variant", F.explode(F.transform("_bare", context)).alias("_t")).select(
        *keys, "variant", "_t.*"
    )


def _adjusted(valence: Column, shout: Column, weight: Column, previous: Sequence[Column]) -> Column:
    sign = F.signum(valence)
    v = F.when(shout, valence + sign * fixed.CAPS_BOOST).otherwise(valence)
    for word, decay in zip(previous, fixed.BOOST_DECAY):
        step = F.when(_isin(word, fixed.BOOST_UP), fixed.BOOST * decay).when(
            _isin(word, fixed.BOOST_DOWN), -fixed.BOOST * decay
        ).otherwise(0.0)
        v = (v + sign * step) * F.when(_isin(word, fixed.NEGATORS), fixed.NEGATION_FACTOR).otherwise(1.0)
    return v * weight


def _compound(total: Column, text: Column) -> Column:
    marks = F.least(F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))), F.lit(fixed.MAX_EXCLAMATIONS))
    asks = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    emphasis = marks * fixed.EXCLAMATION_STEP + F.when(asks <= 1, 0.0).when(
        asks <= 3, asks * fixed.QUESTION_STEP
    ).otherwise(fixed.QUESTION_MAX)
    s = F.when(total > 0, total + emphasis).when(total < 0, total - emphasis).otherwise(0.0)
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s / F.sqrt(s * s + fixed.VALENCE_ALPHA))), 4)


def text_valence(turns: DataFrame, lexicon: DataFrame, keys: Sequence[str] = ("call_id", "turn_index")) -> DataFrame:
    """Add `valence` in [-1, 1] (0 for blank text) and `mere_decline` per turn.

    Only words found in the lexicon survive the join, and they are summed per turn before any shuffle. The text and its
    refusal-free variant are scored in the same pass. The lexicon is sent to the words: left to its guesses, Catalyst takes a
    lexicon of unknown size for the larger side and sends all words of all turns through the driver.
    """
    turns_kept = computed_once(turns, _kept=refusal_free(F.col("text")))
    kept = F.col("_kept")
    both = F.array(
        F.struct(F.lit(0).alias("variant"), tx.words(F.col("text")).alias("_w")),
        F.struct(F.lit(1).alias("variant"), kept.alias("_w")),
    )
    texts = turns_kept.select(*keys, F.explode(both).alias("_b")).select(*keys, "_b.*")
    tokens = _token_contexts(texts, keys)
    value = _adjusted(F.col("valence"), F.col("shout"), F.col("weight"), [F.col("p1"), F.col("p2"), F.col("p3")])
    sums = (
        tokens.join(F.broadcast(lexicon), "token")
        .select(*keys, "variant", value.alias("_v"))
        .groupBy(*keys)
        .agg(
            F.sum(F.when(F.col("variant") == 0, F.col("_v"))).alias("_s0"),
            F.sum(F.when(F.col("variant") == 1, F.col("_v"))).alias("_s1"),
        )
    )
    n_all, n_kept = tx.word_count(F.col("text")), F.size(kept)
    scored = turns_kept.join(sums.hint("merge"), list(keys), "left")
    plain = _compound(F.coalesce(F.col("_s0"), F.lit(0.0)), F.col("text"))
    rest = _compound(F.coalesce(F.col("_s1"), F.lit(0.0)), F.array_join(kept, " "))
    decline = F.when(n_kept == n_all, False).when(n_kept == 0, True).otherwise(rest > -0.05)
    return scored.select(*turns.columns, plain.alias("valence"), decline.alias("mere_decline"))


def prosody(turns: DataFrame, pause: float = fixed.PAUSE_GAP) -> DataFrame:
    """Add words per second, pause share and whether the turn is long enough to measure. Array expressions only."""
    ws = F.col("words")
    count = F.when(ws.isNotNull() & (F.size(ws) > 0), F.size(ws)).otherwise(tx.word_count(F.col("text")))
    seconds = F.greatest(F.col("end_seconds") - F.col("start_seconds"), F.lit(1e-6))
    gaps = F.zip_with(
        F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))),
        F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1))),
        lambda a, b: b["start"] - a["end"],
    )
    silent = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + F.when(g > pause, g).otherwise(0.0))
    return turns.select(
        *turns.columns,
        (count / seconds).alias("words_per_second"),
        F.least(F.coalesce(silent, F.lit(0.0)) / seconds, F.lit(1.0)).alias("pause_share"),
        ((count >= fixed.MIN_PROSODY_WORDS) & (seconds >= fixed.MIN_PROSODY_SECONDS)).alias("measurable"),
    )


def median_rates(measured: DataFrame) -> DataFrame:
    """Exact median speaking rate per call over its measurable customer turns."""
    usable = measured.where((F.col("speaker") == "customer") & F.col("measurable"))
    return exact_median(usable, "words_per_second", ["call_id"], "median_rate")


def prosody_valence(rate: Column, median: Column, pause_share: Column, measurable: Column) -> Column:
    ratio = F.when(median > 0, rate / median).otherwise(1.0)
    raw = fixed.RATE_EFFECT * -(ratio - 1.0) + fixed.PAUSE_EFFECT * -pause_share
    return F.when(measurable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))).otherwise(0.0)


def fused_score(text_score: Column, prosody_score: Column) -> Column:
    raw = fixed.TEXT_WEIGHT * text_score + fixed.PROSODY_WEIGHT * prosody_score
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))


def mood_points(turns: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The mood series: one scored point per customer turn, with the flags later stages filter on."""
    customer = turns.where(F.col("speaker") == "customer")
    # The medians come from their own narrow branch, so sentiment is computed once.
    medians = median_rates(prosody(customer).select("call_id", "speaker", "words_per_second", "measurable"))
    joined = prosody(text_valence(customer, lexicon)).join(medians.hint("merge"), "call_id", "left")
    text_score = F.when((F.col("valence") < 0) & F.col("mere_decline"), 0.0).otherwise(F.col("valence"))
    delivery = prosody_valence(
        F.col("words_per_second"), F.coalesce("median_rate", F.lit(0.0)), F.col("pause_share"), F.col("measurable")
    )
    return (
        joined.withColumn("text_score", text_score)
        .withColumn("prosody_score", delivery)
        .select(
            "call_id",
            "turn_index",
            F.col("start_seconds").alias("seconds"),
            "text_score",
            "prosody_score",
            fused_score(F.col("text_score"), F.col("prosody_score")).alias("score"),
            tx.is_substantive(F.col("text")).alias("substantive"),
            tx.is_citable(F.col("speaker"), F.col("text")).alias("citable"),
        )
    )


def escalation_hits(turns: DataFrame, phrases: Sequence[str] = fixed.ESCALATION_PHRASES) -> DataFrame:
    """`(call_id, turn_index, phrase_no, phrase)` for every phrase a customer used; tested inside the row, no join."""
    lowered = F.lower(F.col("text"))
    found = F.filter(
        F.array(*[F.struct(F.lit(i).alias("phrase_no"), F.lit(p).alias("phrase")) for i, p in enumerate(phrases)]),
        lambda p: F.contains(lowered, p["phrase"]),
    )
    return turns.where(F.col("speaker") == "customer").select(
        "call_id", "turn_index", F.explode(found).alias("_p")
    ).select("call_id", "turn_index", "_p.phrase_no", "_p.phrase")


def escalation_summary(hits: DataFrame) -> DataFrame:
    """Per call: number of hits and the first one."""
    return hits.groupBy("call_id").agg(
        F.count("*").alias("escalation_count"),
        F.min(F.struct("turn_index", "phrase_no", "phrase")).alias("_f"),
    ).select(
        "call_id",
        "escalation_count",
        F.col("_f.turn_index").alias("escalation_turn_index"),
        F.col("_f.phrase").alias("escalation_phrase"),
    )


def worst_mood(points: DataFrame) -> DataFrame:
    """Lowest score per call, earliest turn on ties; the turn is named only when it can be quoted."""
    return points.groupBy("call_id").agg(F.min(F.struct("score", "turn_index", "citable")).alias("_w")).select(
        "call_id",
        F.col("_w.score").alias("worst_mood"),
        F.when(F.col("_w.citable"), F.col("_w.turn_index")).alias("worst_mood_turn_index"),
    )


def mood_timeline(turns: DataFrame, points: DataFrame) -> DataFrame:
    scored = points.where(F.col("score").isNotNull()).select("call_id", "turn_index", "score")
    return turns.join(scored.hint("merge"), ["call_id", "turn_index"]).select(
        "call_id", "turn_index", F.col("start_seconds").alias("seconds"), "score", "text"
    )
