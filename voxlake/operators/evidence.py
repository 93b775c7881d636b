"""Every claim tied to a verbatim quote, and every quote checked for presence and support."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake import fixed
from voxlake.functions import similarity as sim
from voxlake.functions import text as tx
from voxlake.functions.once import computed_once

# Order in which citations of one turn win.
CLAIM_ORDER = {
    "intent": 0,
    "resolution": 1,
    "mood_shift": 2,
    "resolution_contradiction_agent": 3,
    "resolution_contradiction_customer": 4,
    "attention_factor": 5,
}
SELECTED = ("call_id", "claim_type", "claim_text", "turn_index", "ord")


@dataclass(frozen=True)
class Support:
    """How a claim is compared with a quote: word sets, or vectors from a caller's `array<string>` embedding UDF."""

    method: str = "lexical"
    embed: Callable[[Column], Column] | None = None

    @property
    def threshold(self) -> float:
        return fixed.VECTOR_SUPPORT if self.method == "embedding" else fixed.LEXICAL_SUPPORT

    def add_scores(self, df: DataFrame, claim: Column, others: Column, name: str) -> DataFrame:
        """Add the similarity 0-1 of the claim to each text of an array."""
        if self.method == "embedding":
            embedded = df.withColumn("_vectors", self.embed(F.concat(F.array(claim), others)))
            rest = F.slice("_vectors", 2, F.greatest(F.size("_vectors") - 1, F.lit(0)))
            scored = F.transform(rest, lambda v: sim.vector_support(F.get("_vectors", 0), v))
            return embedded.withColumn(name, scored).drop("_vectors")
        return sim.with_token_set_ratios(df, claim, others, name)


def select_quotes(claims: DataFrame, support: Support = Support()) -> DataFrame:
    """Add `quote`: the sentence of `text` closest to `claim_text`, cut to 30 words; the whole turn if one sentence.

    All sentences of a turn are compared inside its row, so nothing is shuffled.
    """
    split = computed_once(claims, _s=tx.sentences(F.col("text")))
    long_enough = F.filter("_s", lambda s: tx.word_count(s) >= 3)
    split = computed_once(split, _c=F.when(F.size("_s") > 1, long_enough).otherwise(F.array().cast("array<string>")))
    scored = support.add_scores(split, F.col("claim_text"), F.col("_c"), "_r")
    best = F.get("_c", (F.array_position("_r", F.array_max("_r")) - 1).cast("int"))
    chosen = F.when(F.size("_s") <= 1, F.col("text")).otherwise(F.coalesce(best, F.get(F.col("_s"), 0)))
    return computed_once(scored, quote=tx.first_words(chosen, fixed.MAX_QUOTE_WORDS)).select(*claims.columns, "quote")


def claim_to_check(claim_type: Column, claim_text: Column) -> Column:
    """The claim to support-check, or null where the citation points at our own computation."""
    return F.when(~claim_type.isin(list(fixed.SPAN_ONLY_CLAIMS)), claim_text)


def verify(citations: DataFrame, support: Support = Support(), span_threshold: float = fixed.SPAN_THRESHOLD) -> DataFrame:
    """Add `verified, match_score, support_score, method, reason`.

    In: `quote`, `text` (the cited turn) and `claim` (null: span check only). A verbatim quote is recognised natively;
    only other quotes reach the window search.
    """
    q, t = F.col("_q"), F.col("_t")
    normal = computed_once(citations, _q=tx.normalise(F.col("quote")), _t=tx.normalise(F.col("text")))
    normal = computed_once(
        normal, _short=tx.word_count(q) < fixed.MIN_QUOTE_WORDS, _verbatim=F.contains(t, q)
    )
    search = ~F.col("_short") & ~F.col("_verbatim")
    spanned = normal.withColumn("_span", sim.best_span(F.when(search, q), F.when(search, t)))
    spanned = spanned.withColumn(
        "_match", F.when(F.col("_short"), 0.0).when(F.col("_verbatim"), 100.0).otherwise(F.col("_span.score"))
    ).withColumn("_ratio", F.when(F.col("_verbatim"), 1.0).otherwise(F.col("_span.span") / F.greatest(F.length(q), F.lit(1))))
    present = (
        ~F.col("_short") & (F.col("_match") >= span_threshold) & (F.col("_ratio") >= fixed.MIN_SPAN_RATIO)
    )
    spanned = spanned.withColumn("_present", present).withColumn("_checked", present & F.col("claim").isNotNull())
    claim, quote = F.when(F.col("_checked"), F.col("claim")), F.when(F.col("_checked"), F.array("quote"))
    scored = support.add_scores(spanned, claim, quote, "_r").withColumn("_support", F.get("_r", 0))
    supported = F.col("_support") >= support.threshold
    reason = (
        F.when(F.col("_short"), fixed.REASON_SHORT)
        .when(F.col("_match") < span_threshold, fixed.REASON_ABSENT)
        .when(F.col("_ratio") < fixed.MIN_SPAN_RATIO, fixed.REASON_FRAGMENT)
        .when(F.col("_checked") & ~supported, fixed.REASON_UNSUPPORTED)
        .otherwise("")
    )
    return scored.select(
        *citations.columns,
        (F.col("_present") & (F.col("claim").isNull() | supported)).alias("verified"),
        F.col("_match").alias("match_score"),
        F.when(F.col("_checked"), F.col("_support") * 100).otherwise(0.0).alias("support_score"),
        F.when(F.col("_checked"), support.method).otherwise("none").alias("method"),
        reason.alias("reason"),
    )


def build_evidence(claims: DataFrame, turns: DataFrame, support: Support = Support()) -> DataFrame:
    """Resolve claims to verified citations. Claims that point outside the call yield nothing.

    In: `call_id, claim_type, claim_text, turn_index, ord, check_support`.
    """
    # Merged, as a guess of the size of the turns may be low enough for Catalyst to send all texts through the driver.
    texts = turns.select("call_id", "turn_index", "text", "start_seconds").hint("merge")
    cited = claims.join(texts, ["call_id", "turn_index"])
    quoted = select_quotes(cited, support).withColumn(
        "claim", F.when(F.col("check_support"), claim_to_check(F.col("claim_type"), F.col("claim_text")))
    )
    return verify(quoted, support).select(
        *SELECTED, tx.clock(F.col("start_seconds")).alias("timestamp"), "quote", "match_score", "support_score",
        "verified", "method", "reason",
    )


def _claims(source: DataFrame, kind: str, text: Column, turn: str, check: bool = True) -> DataFrame:
    return source.select(
        "call_id",
        F.lit(kind).alias("claim_type"),
        text.alias("claim_text"),
        F.col(turn).cast("int").alias("turn_index"),
        F.lit(CLAIM_ORDER[kind]).alias("ord"),
        F.lit(check).alias("check_support"),
    )


def resolution_claim(label: Column, status: Column) -> Column:
    return F.concat(F.lit("the customer wanted to "), label, F.lit("; this was "), status)


def judgment_claims(judgments: DataFrame) -> DataFrame:
    label, status = F.col("intent_label"), F.col("resolution_status")
    return _claims(judgments, "intent", label, "intent_turn_index").unionByName(
        _claims(judgments, "resolution", resolution_claim(label, status), "resolution_turn_index")
    )


def shift_claims(shifts: DataFrame) -> DataFrame:
    said = F.when(F.col("delta") < 0, fixed.CLAIM_SHIFT_WORSE).otherwise(fixed.CLAIM_SHIFT_BETTER)
    return _claims(shifts, "mood_shift", said, "turn_index", check=False)


def contradiction_claims(found: DataFrame) -> DataFrame:
    return _claims(
        found, "resolution_contradiction_agent", F.lit(fixed.CLAIM_AGENT_RESOLVED), "agent_turn_index"
    ).unionByName(
        _claims(found, "resolution_contradiction_customer", F.lit(fixed.CLAIM_CUSTOMER_DENIES), "customer_turn_index")
    )


def _first_citation(evidence: DataFrame) -> DataFrame:
    """The citation that stands for each turn: first by claim order."""
    return evidence.groupBy("call_id", "turn_index").agg(
        F.min(F.struct("ord", "claim_text", "timestamp", "quote", "verified")).alias("_e")
    )


def cite_factors(
    scores: DataFrame, evidence: DataFrame, turns: DataFrame, support: Support = Support()
) -> tuple[DataFrame, DataFrame]:
    """Give every factor that points at a turn a citation: the turn's existing one, else a new one.

    Returns `(scores with factors that carry evidence, evidence including the new rows)`.
    """
    flat = scores.select("call_id", "attention_score", F.posexplode("factors").alias("place", "f")).select(
        "call_id", "attention_score", "place", "f.*"
    )
    pointing = flat.where(F.col("turn_index").isNotNull())
    missing = (
        pointing.join(evidence.select("call_id", "turn_index").distinct().hint("merge"), ["call_id", "turn_index"], "left_anti")
        .groupBy("call_id", "turn_index")
        .agg(F.min(F.struct("place", "factor", "check_support")).alias("_f"))
        .select(
            "call_id",
            F.lit("attention_factor").alias("claim_type"),
            F.col("_f.factor").alias("claim_text"),
            "turn_index",
            F.lit(CLAIM_ORDER["attention_factor"]).alias("ord"),
            F.col("_f.check_support").alias("check_support"),
        )
    )
    every = evidence.unionByName(build_evidence(missing, turns, support))
    known = _first_citation(every)
    payload = F.when(
        F.col("_e").isNotNull(), F.struct("turn_index", "_e.timestamp", "_e.quote", "_e.verified")
    )
    cited = pointing.join(known.hint("merge"), ["call_id", "turn_index"], "left").select(
        "call_id", "place", payload.alias("evidence")
    )
    # A score has at most seven factors, so the list per call stays small.
    rows = cited.groupBy("call_id").agg(
        F.map_from_entries(F.collect_list(F.struct("place", "evidence"))).alias("_by_place")
    )
    full = F.transform(
        "factors",
        lambda f, i: F.struct(
            f["factor"].alias("factor"),
            f["weight"].alias("weight"),
            f["turn_index"].alias("turn_index"),
            f["detail"].alias("detail"),
            f["check_support"].alias("check_support"),
            F.when(F.col("_by_place").isNotNull(), F.try_element_at("_by_place", i)).alias("evidence"),
        ),
    )
    return scores.join(rows.hint("merge"), "call_id", "left").withColumn("factors", full).drop("_by_place"), every


def factor_payloads(scores: DataFrame) -> DataFrame:
    """Factors as JSON text, for the edge."""
    slim = F.transform(
        "factors",
        lambda f: F.struct(f["factor"].alias("factor"), f["weight"].alias("weight"), f["evidence"].alias("evidence")),
    )
    return scores.withColumn("factors_json", F.to_json(slim, {"ignoreNullFields": "false"}))


def cited_turns(evidence: DataFrame) -> DataFrame:
    """The turn behind the first citation of each judgment type, one row per call, for a rescore."""
    first = lambda kind: F.min(F.when(F.col("claim_type") == kind, F.col("turn_index")))
    return evidence.groupBy("call_id").agg(
        first("intent").alias("intent_turn_index"),
        first("resolution").alias("resolution_turn_index"),
        first("resolution_contradiction_customer").alias("contradiction_turn_index"),
    )


def coverage(evidence: DataFrame) -> DataFrame:
    """Percent of verified citations per call, one decimal."""
    share = F.avg(F.col("verified").cast("double"))
    return evidence.groupBy("call_id").agg(F.round(share * 100, 1).alias("evidence_coverage"))


def corpus_coverage(evidence: DataFrame) -> DataFrame:
    return evidence.agg(F.round(F.avg(F.col("verified").cast("double")) * 100, 1).alias("evidence_coverage_pct"))


def with_coverage(calls: DataFrame, evidence: DataFrame) -> DataFrame:
    """Attach coverage; only the evidence of the given calls is aggregated."""
    wanted = evidence.join(calls.select("call_id"), "call_id", "left_semi")
    return calls.join(coverage(wanted), "call_id", "left")


def first_evidence(evidence: DataFrame) -> DataFrame:
    """The first citation per call and claim type."""
    body = F.struct("turn_index", "ord", "timestamp", "quote", "verified")
    return evidence.groupBy("call_id", "claim_type").agg(F.min(body).alias("_e")).select(
        "call_id", "claim_type", "_e.turn_index", "_e.timestamp", "_e.quote", "_e.verified"
    )
