"""Repeat contact: how often the same customer called about the same issue before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake import fixed
from voxlake.functions import text as tx
from voxlake.functions.scan import running_totals

DAY_MICROS = 86_400_000_000
BLOCK_MICROS = 3_600_000_000


def prior_counts(
    calls: DataFrame,
    keys: Sequence[str],
    window_days: int | None = None,
    block_micros: int = BLOCK_MICROS,
    name: str = "repeat_count",
) -> DataFrame:
    """Add how many strictly earlier calls share `keys`, at most `window_days` back when given.

    One ordered sweep, no self-join: a call adds one from its own time on and, with a window, takes it away again just
    after the window. Rows with a null key count 0. In: `call_id, started_at` and `keys`.
    """
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    at = tx.micros(F.col("started_at"))
    arrivals = calls.where(known).select("*", at.alias("_at"), F.lit(1).alias("_d"))
    sweep = arrivals
    if window_days is not None:
        left = arrivals.select(
            *[F.col(k) for k in keys], (F.col("_at") + window_days * DAY_MICROS).alias("_at"), F.lit(-1).alias("_d")
        )
        sweep = arrivals.unionByName(left, allowMissingColumns=True)
    counted = running_totals(
        sweep, list(keys), [F.col("_at")], F.floor(F.col("_at") / block_micros), {name: F.col("_d")}, before=True
    )
    found = counted.where(F.col("_d") == 1).select(*calls.columns, F.col(name).cast("int").alias(name))
    unknown = calls.where(~known).select("*", F.lit(0).alias(name))
    return found.unionByName(unknown)


def prior_same_cluster(calls: DataFrame, call_clusters: DataFrame, days: int = fixed.REPEAT_WINDOW_DAYS) -> DataFrame:
    """`(call_id, repeat_count)` by customer and issue cluster inside the window; calls without a cluster count 0."""
    placed = calls.select("call_id", "customer_id", "started_at").join(
        call_clusters.select("call_id", "cluster_id").hint("merge"), "call_id", "left"
    )
    return prior_counts(placed, ["customer_id", "cluster_id"], days).select("call_id", "repeat_count")


def prior_same_intent(calls: DataFrame) -> DataFrame:
    """`(call_id, repeat_count)` by customer and intent label, without a time limit; blank intent counts 0."""
    slim = calls.select("call_id", "customer_id", "started_at", F.nullif(F.col("intent_label"), F.lit("")).alias("_intent"))
    return prior_counts(slim, ["customer_id", "_intent"]).select("call_id", "repeat_count")


def repeat_groups(
    calls: DataFrame,
    call_clusters: DataFrame,
    customers: DataFrame,
    issues: DataFrame,
    min_calls: int = fixed.MIN_REPEAT_CALLS,
    limit: int | None = 50,
) -> DataFrame:
    """Customer-issue pairs with at least `min_calls` calls. Names are joined after the aggregation."""
    grouped = (
        calls.select("call_id", "customer_id", "started_at", "resolution_status")
        .join(call_clusters.select("call_id", "cluster_id"), "call_id")
        .groupBy("customer_id", "cluster_id")
        .agg(
            F.count("*").alias("call_count"),
            F.count_if(F.col("resolution_status").isin("unresolved", "partial")).alias("unresolved_count"),
            F.min("started_at").alias("first_call_at"),
            F.max("started_at").alias("last_call_at"),
        )
        .where(F.col("call_count") >= min_calls)
    )
    span = (tx.micros(F.col("last_call_at")) - tx.micros(F.col("first_call_at"))) / DAY_MICROS
    named = (
        grouped.join(customers.select("customer_id", F.col("name").alias("customer_name")), "customer_id")
        .join(issues.select("cluster_id", F.col("label").alias("issue_label")), "cluster_id")
        .select(
            "customer_id", "customer_name", "cluster_id", "issue_label", "call_count", "unresolved_count",
            "first_call_at", "last_call_at", F.round(span, 1).alias("span_days"),
        )
    )
    if limit is None:
        return named
    return named.orderBy(
        F.desc("call_count"), F.desc("unresolved_count"), F.asc("customer_id"), F.asc("cluster_id")
    ).limit(limit)


def group_members(groups: DataFrame, calls: DataFrame, call_clusters: DataFrame) -> DataFrame:
    """All calls of the given groups, flat; one row per call."""
    placed = calls.join(call_clusters.select("call_id", "cluster_id"), "call_id")
    return placed.join(groups.select("customer_id", "cluster_id"), ["customer_id", "cluster_id"], "left_semi")


def unresolved_groups(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count_if(F.col("unresolved_count") > 0).alias("unresolved_groups"))
