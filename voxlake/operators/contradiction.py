"""Does the customer's own later turn contradict a call labelled resolved?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake import fixed


def contradictions(
    turns: DataFrame, agent_pattern: str = fixed.AGENT_CLAIM, customer_pattern: str = fixed.CUSTOMER_PUSHBACK
) -> DataFrame:
    """First agent claim and the first later customer pushback per call.

    If the earliest claim has no later pushback then no later claim has one, so the earliest claim decides.
    """
    claim = (F.col("speaker") == "agent") & F.col("text").rlike(agent_pattern)
    push = (F.col("speaker") == "customer") & F.col("text").rlike(customer_pattern)
    marked = turns.select("call_id", "turn_index", claim.alias("_claim"), push.alias("_push")).where("_claim or _push")
    first = marked.where("_claim").groupBy("call_id").agg(F.min("turn_index").alias("agent_turn_index"))
    return (
        marked.where("_push")
        .join(first.hint("merge"), "call_id")
        .where(F.col("turn_index") > F.col("agent_turn_index"))
        .groupBy("call_id", "agent_turn_index")
        .agg(F.min("turn_index").alias("customer_turn_index"))
    )


def resolved_contradictions(turns: DataFrame, judgments: DataFrame, **patterns: str) -> DataFrame:
    resolved = judgments.where(F.col("resolution_status") == "resolved").select("call_id")
    return contradictions(turns, **patterns).join(resolved.hint("merge"), "call_id", "left_semi")
