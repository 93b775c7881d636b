"""Read views: ranked queues, histories and aggregates over calls, clusters, agents and evidence.

Aggregates run before dimension joins, so a customer or agent with a large share of all calls is one partial row per
task by the time it is shuffled. Coverage is joined after a top-k, for the calls that are shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake import fixed
from voxlake.operators.evidence import corpus_coverage, coverage, first_evidence, with_coverage

SUMMARY = (
    "call_id", "started_at", "duration_seconds", "intent_label", "resolution_status", "summary", "attention_score",
)


def most_urgent() -> list[Column]:
    return [F.col("attention_score").desc_nulls_last(), F.col("started_at").desc(), F.col("call_id").asc()]


def resolved_share(status: Column) -> Column:
    """Mean of resolved over calls that have a status."""
    return F.avg(F.when(status.isNull(), None).when(status == "resolved", 1.0).otherwise(0.0))


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def _outcomes() -> list[Column]:
    return [
        F.count("*").alias("call_count"),
        _or_zero(resolved_share(F.col("resolution_status"))).alias("resolution_rate"),
        _or_zero(F.avg("attention_score")).alias("avg_attention_score"),
        _or_zero(F.avg("duration_seconds")).alias("avg_handle_time_seconds"),
    ]


def analysed(calls: DataFrame) -> DataFrame:
    return calls.where(F.col("analyzed_at").isNotNull())


# Customers


def customer_list(customers: DataFrame, calls: DataFrame) -> DataFrame:
    per = calls.groupBy("customer_id").agg(F.count("*").alias("call_count"), F.max("started_at").alias("last_contact"))
    return (
        customers.select("customer_id", "name")
        .join(per, "customer_id", "left")
        .select("customer_id", "name", F.coalesce("call_count", F.lit(0)).alias("call_count"), "last_contact")
        .orderBy(F.desc("call_count"), F.asc("name"), F.asc("customer_id"))
    )


def customer_search(customers: DataFrame, fragment: str) -> DataFrame:
    return customers.where(F.contains(F.lower("name"), F.lit(fragment.lower())))


def customer_history(calls: DataFrame, evidence: DataFrame, customer_id) -> DataFrame:
    own = calls.where(F.col("customer_id") == customer_id).select(*SUMMARY)
    return with_coverage(own, evidence).orderBy(F.desc("started_at"), F.asc("call_id"))


# Days and the queue


def days(calls: DataFrame) -> DataFrame:
    return calls.groupBy("call_date").agg(F.count("*").alias("call_count")).orderBy(F.desc("call_date"))


def latest_day(calls: DataFrame) -> DataFrame:
    return calls.agg(F.max("call_date").alias("call_date"))


def calls_of_day(calls: DataFrame, day=None) -> DataFrame:
    """Calls of a day; of the latest day with calls when none is given (a scalar subquery, no join)."""
    wanted = latest_day(calls).scalar() if day is None else F.lit(day).cast("date")
    return calls.where(F.col("call_date") == wanted)


def attention_queue(calls: DataFrame, evidence: DataFrame, day=None, limit: int = 100) -> DataFrame:
    top = calls_of_day(calls, day).select(*SUMMARY).orderBy(*most_urgent()).limit(limit)
    return with_coverage(top, evidence).orderBy(*most_urgent())


def overview_counters(calls: DataFrame, evidence: DataFrame, day=None) -> DataFrame:
    score = F.col("attention_score")
    counted = calls_of_day(calls, day).agg(
        F.count_if(score >= 75).alias("critical_count"),
        F.count_if(score >= 50).alias("flagged_count"),
        F.coalesce(F.max(score), F.lit(0)).alias("top_score"),
    )
    share = corpus_coverage(evidence).scalar()
    tone = (
        F.when(F.col("evidence_coverage_pct").isNull(), "neutral")
        .when(F.col("evidence_coverage_pct") >= 85, "good")
        .when(F.col("evidence_coverage_pct") >= 70, "warning")
        .otherwise("critical")
    )
    attention = (
        F.when(F.col("critical_count") > 0, "critical").when(F.col("flagged_count") > 0, "warning").otherwise("good")
    )
    return (
        counted.withColumn("evidence_coverage_pct", share)
        .withColumn("attention_tone", attention)
        .withColumn("coverage_tone", tone)
    )


# One call


def call_detail(
    calls: DataFrame, customers: DataFrame, agents: DataFrame, evidence: DataFrame, call_id=None, attention: DataFrame | None = None
) -> DataFrame:
    """Header of one call (or of every call): names, judgments, first citation per claim, coverage.

    With `attention`, the scores with cited factors as `analyse` or `rescore` gives them, also `attention_factors`: name,
    weight and citation (null if the factor points at no turn) by falling weight; empty for a call without a score.
    The turns are a separate flat view, `call_turns`, so a header row never grows with the length of its call.
    """
    chosen = calls if call_id is None else calls.where(F.col("call_id") == call_id)
    wanted = evidence if call_id is None else evidence.where(F.col("call_id") == call_id)
    body = F.struct("turn_index", "timestamp", "quote", "verified")
    cites = {
        "intent": "intent_evidence",
        "resolution": "resolution_evidence",
        "mood_shift": "mood_shift_evidence",
        "resolution_contradiction_agent": "_agent",
        "resolution_contradiction_customer": "_customer",
    }
    first = first_evidence(wanted)
    wide = first.groupBy("call_id").agg(
        *[F.max(F.when(F.col("claim_type") == kind, body)).alias(name) for kind, name in cites.items()]
    )
    both = F.when(
        F.col("_agent").isNotNull() & F.col("_customer").isNotNull(),
        F.struct(F.col("_agent").alias("agent_evidence"), F.col("_customer").alias("customer_evidence")),
    )
    if attention is not None:
        slim = F.transform("factors", lambda f: F.struct(f["factor"].alias("factor"), f["weight"].alias("weight"), f["evidence"].alias("evidence")))
        scored = attention if call_id is None else attention.where(F.col("call_id") == call_id)
        chosen = chosen.join(scored.select("call_id", slim.alias("attention_factors")), "call_id", "left")
        chosen = chosen.withColumn("attention_factors", F.coalesce("attention_factors", F.array().cast(chosen.schema["attention_factors"].dataType)))
    return (
        chosen.join(customers.select("customer_id", F.col("name").alias("customer_name")), "customer_id")
        .join(agents.select("agent_id", F.col("name").alias("agent_name")), "agent_id")
        .join(wide, "call_id", "left")
        .join(coverage(wanted), "call_id", "left")
        .withColumn("resolution_contradiction", both)
        .drop("_agent", "_customer")
    )


def call_turns(turns: DataFrame, points: DataFrame | None = None, call_id=None) -> DataFrame:
    chosen = turns if call_id is None else turns.where(F.col("call_id") == call_id)
    if points is not None:
        chosen = chosen.join(points.select("call_id", "turn_index", F.col("score").alias("mood_score")), ["call_id", "turn_index"], "left")
    return chosen if call_id is None else chosen.orderBy("turn_index")


# Issues


def baseline(calls: DataFrame) -> DataFrame:
    return analysed(calls).agg(*_outcomes())


def _clustered(calls: DataFrame, call_clusters: DataFrame) -> DataFrame:
    return calls.join(call_clusters.select("call_id", "cluster_id"), "call_id")


def issue_outcomes(
    calls: DataFrame, call_clusters: DataFrame, issues: DataFrame, limit: int | None = 25
) -> DataFrame:
    """Outcome figures per issue over analysed calls, largest first."""
    per = _clustered(analysed(calls), call_clusters).groupBy("cluster_id").agg(*_outcomes())
    named = per.join(issues.select("cluster_id", "label"), "cluster_id")
    if limit is None:
        return named
    return named.orderBy(F.desc("call_count"), F.asc("cluster_id")).limit(limit)


def issue_days(calls: DataFrame, call_clusters: DataFrame) -> DataFrame:
    """Per issue and day: calls and the share of that day's analysed calls."""
    done = analysed(calls)
    totals = done.groupBy("call_date").agg(F.count("*").alias("day_total"))
    per = _clustered(done, call_clusters).groupBy("cluster_id", "call_date").agg(F.count("*").alias("call_count"))
    return per.join(totals, "call_date").select(
        "cluster_id", "call_date", "call_count", (F.col("call_count") / F.col("day_total")).alias("share")
    )


def issue_day_maps(daily: DataFrame) -> DataFrame:
    """The same, nested: two maps per issue. Their size is the number of days."""
    entry = lambda v: F.map_from_entries(F.sort_array(F.collect_list(F.struct("call_date", v))))
    return daily.groupBy("cluster_id").agg(
        entry("call_count").alias("counts_by_day"), entry("share").alias("share_by_day")
    )


def cluster_calls(
    calls: DataFrame, call_clusters: DataFrame, evidence: DataFrame, cluster_id, limit: int = 200
) -> DataFrame:
    members = call_clusters.where(F.col("cluster_id") == cluster_id)
    top = calls.join(members, "call_id", "left_semi").select(*SUMMARY).orderBy(*most_urgent()).limit(limit)
    return with_coverage(top, evidence).orderBy(*most_urgent())


def _base(calls: DataFrame) -> Column:
    return baseline(calls).select(F.struct("*").alias("b")).scalar()


def issue_comparison(outcomes: DataFrame, calls: DataFrame) -> DataFrame:
    """Each issue against the baseline: resolution gap, relative attention, volume relative to the largest."""
    largest = outcomes.agg(F.max("call_count")).scalar()
    b = F.col("_b")
    return (
        outcomes.withColumn("_b", _base(calls))
        .withColumn("resolution_gap", F.col("resolution_rate") - b["resolution_rate"])
        .withColumn(
            "attention_gap",
            F.when(b["avg_attention_score"] > 0, F.col("avg_attention_score") / b["avg_attention_score"] - 1).otherwise(0.0),
        )
        .withColumn("relative_volume", F.col("call_count") / largest)
        .drop("_b")
    )


def underperforming_issues(outcomes: DataFrame, calls: DataFrame, gap: float = fixed.ISSUE_ALERT_GAP) -> DataFrame:
    flagged = issue_comparison(outcomes, calls).where(F.col("resolution_gap") < -gap)
    return flagged.orderBy(F.asc("resolution_rate"), F.asc("cluster_id"))


def top_issues(outcomes: DataFrame, calls: DataFrame, limit: int = 4, gap: float = fixed.ISSUE_ALERT_GAP) -> DataFrame:
    compared = issue_comparison(outcomes, calls).withColumn("underperforming", F.col("resolution_gap") < -gap)
    return compared.orderBy(F.desc("underperforming"), F.desc("call_count"), F.asc("cluster_id")).limit(limit)


def day_strip(daily: DataFrame) -> DataFrame:
    """Each day's share relative to the issue's own peak."""
    peaks = daily.groupBy("cluster_id").agg(F.greatest(F.max("share"), F.lit(0.001)).alias("peak"))
    return daily.join(peaks, "cluster_id").select(
        "cluster_id", "call_date", "share", (F.col("share") / F.col("peak")).alias("relative_share")
    )


# Agents


def agent_overview(agents: DataFrame, calls: DataFrame) -> DataFrame:
    """Volume counts every call; rate and attention come from analysed calls."""
    status = F.when(F.col("analyzed_at").isNotNull(), F.col("resolution_status"))
    score = F.when(F.col("analyzed_at").isNotNull(), F.col("attention_score"))
    per = calls.groupBy("agent_id").agg(
        F.count("*").alias("call_count"),
        F.avg("duration_seconds").alias("avg_handle_time_seconds"),
        resolved_share(status).alias("resolution_rate"),
        F.avg(score).alias("avg_attention_score"),
    )
    return (
        agents.select("agent_id", "name")
        .join(per, "agent_id", "left")
        .select(
            "agent_id",
            "name",
            F.coalesce("call_count", F.lit(0)).alias("call_count"),
            *[_or_zero(F.col(c)).alias(c) for c in ("avg_handle_time_seconds", "resolution_rate", "avg_attention_score")],
        )
        .orderBy(F.desc("call_count"), F.asc("name"), F.asc("agent_id"))
    )


def top_agents(overview: DataFrame, limit: int = 5) -> DataFrame:
    return overview.orderBy(F.desc("call_count"), F.asc("agent_id")).limit(limit)


def agent_rates(calls: DataFrame) -> DataFrame:
    return analysed(calls).groupBy("agent_id").agg(
        _or_zero(resolved_share(F.col("resolution_status"))).alias("agent_rate")
    )


def agent_issues(
    calls: DataFrame, call_clusters: DataFrame, issues: DataFrame, agent_id=None, min_calls: int = fixed.MIN_ISSUE_CALLS
) -> DataFrame:
    """Per agent and issue with enough calls: rate and its distance from the agent's own rate.

    One aggregate serves both levels: the agent's own rate is summed from per-cell counts, not from a second scan.
    """
    done = analysed(calls)
    if agent_id is not None:
        done = done.where(F.col("agent_id") == agent_id)
    rated = F.count("resolution_status")
    won = F.count_if(F.col("resolution_status") == "resolved")
    cells = (
        done.select("call_id", "agent_id", "resolution_status")
        .join(call_clusters.select("call_id", "cluster_id"), "call_id", "left")
        .groupBy("agent_id", "cluster_id")
        .agg(F.count("*").alias("call_count"), rated.alias("_rated"), won.alias("_won"))
    )
    own = cells.groupBy("agent_id").agg(
        _or_zero(F.sum("_won") / F.nullif(F.sum("_rated"), F.lit(0))).alias("_own")
    )
    rate = _or_zero(F.col("_won") / F.nullif(F.col("_rated"), F.lit(0)))
    return (
        cells.where(F.col("cluster_id").isNotNull() & (F.col("call_count") >= min_calls))
        .join(own, "agent_id")
        .join(issues.select("cluster_id", "label"), "cluster_id")
        .select(
            "agent_id", "cluster_id", "label", "call_count", rate.alias("resolution_rate"), (rate - F.col("_own")).alias("delta_vs_self")
        )
    )


def weakest_issues(breakdown: DataFrame, delta: float = fixed.WEAK_ISSUE_DELTA) -> DataFrame:
    """Per agent the issue with the lowest rate, when it lies clearly below the agent's own rate."""
    lowest = breakdown.groupBy("agent_id").agg(
        F.min(F.struct("resolution_rate", "cluster_id", "label", "call_count", "delta_vs_self")).alias("_w")
    )
    return lowest.select("agent_id", "_w.*").where(F.col("delta_vs_self") < delta)


def coaching_list(weakest: DataFrame, agents: DataFrame, limit: int = 4) -> DataFrame:
    named = weakest.join(agents.select("agent_id", "name"), "agent_id")
    return named.orderBy(F.asc("delta_vs_self"), F.asc("agent_id")).limit(limit)


def agent_calls(
    calls: DataFrame, evidence: DataFrame, agent_id, call_clusters: DataFrame | None = None, cluster_id=None, limit: int = 200
) -> DataFrame:
    own = calls.where(F.col("agent_id") == agent_id)
    if cluster_id is not None:
        own = own.join(call_clusters.where(F.col("cluster_id") == cluster_id), "call_id", "left_semi")
    top = own.select(*SUMMARY).orderBy(*most_urgent()).limit(limit)
    return with_coverage(top, evidence).orderBy(*most_urgent())
