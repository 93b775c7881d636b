"""The driver tables seen as calls, turns, citations and vectors. Whole tables, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions import text as tx
from voxlake.functions.once import computed_once
from voxlake.functions.scan import index_block, running_totals
from voxlake.session import spread

# Stand-in parameters: frequent word pieces of the invented languages.
PHRASES = ("of the", "und der", "que la", "tion")
LEXICON = (
    ("the", 1.2), ("and", -0.8), ("of", 0.6), ("und", -1.1), ("que", 0.9), ("no", -1.2), ("in", -1.9), ("to", 0.4),
    ("thing", -2.3), ("on", 1.6), ("der", 1.3), ("la", -0.7), ("it", -1.4), ("is", 0.5), ("that", 1.1), ("le", -0.9),
)
GREETING = r"(?i)^\p{L}*th"
AGENT_CLAIM = r"(?i)tion\p{L}* (is|in|of|and|the)"
PUSHBACK = r"(?i)\bthe \p{L}+ing"
CLAIM_TYPES = (
    "intent", "resolution", "attention_factor", "mood_shift", "resolution_contradiction_agent",
    "resolution_contradiction_customer", "intent",
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def calls(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    done = F.col("k") % 25 != 24
    status = F.when(F.col("k") % 10 < 7, "resolved").when(F.col("k") % 10 < 9, "partial").otherwise("unresolved")
    return e.withColumn("k", k).select(
        F.col("event_id").alias("call_id"),
        F.col("user_id").alias("customer_id"),
        (F.col("event_id") % 40).alias("agent_id"),
        F.col("ts").alias("started_at"),
        F.to_date("ts").alias("call_date"),
        F.col("value").alias("duration_seconds"),
        F.when(done, F.col("event_type")).alias("intent_label"),
        F.when(done, status).alias("resolution_status"),
        F.when(done, F.concat(F.lit("asked about "), "event_type", F.lit(" on line "), (F.col("k") % 7).cast("string"))).alias("summary"),
        F.when(done & (F.col("k") % 11 != 10), (F.col("k") * 7 + F.col("event_id")) % 101).cast("int").alias("attention_score"),
        F.when(done & (F.col("k") % 13 == 0), F.col("k") % 7).cast("int").alias("mood_shift_turn_index"),
        F.when(done, F.col("ts") + F.expr("interval 1 hour")).alias("analyzed_at"),
        F.when(F.col("k") % 9 != 8, F.col("ts")).alias("transcribed_at"),
        F.when(F.col("k") % 2 == 0, "alpha").otherwise("beta").alias("transcript_provider"),
    )


def order_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as calls: many share a start time, so strictly earlier is exercised."""
    status = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "P", "partial").otherwise("unresolved")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("call_id"),
        F.col("o_custkey").alias("customer_id"),
        (F.col("o_orderkey") % 10).alias("agent_id"),
        F.col("o_orderdate").alias("started_at"),
        F.col("o_orderpriority").alias("intent_label"),
        F.col("o_orderpriority").alias("cluster_id"),
        status.alias("resolution_status"),
        F.col("o_totalprice").alias("duration_seconds"),
    )


def call_clusters(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.where(k % 50 != 49).select(F.col("event_id").alias("call_id"), F.col("event_type").alias("cluster_id"))


def issues(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("cluster_id")).distinct().select(
        "cluster_id", F.concat(F.lit("issue "), "cluster_id").alias("label")
    )


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"))


def agents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("agent_id"), F.col("s_name").alias("name"))


def call_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as citations of calls."""
    kinds = F.array(*[F.lit(c) for c in CLAIM_TYPES])
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("call_id"),
        F.get(kinds, F.col("l_linenumber") - 1).alias("claim_type"),
        F.col("l_linenumber").alias("turn_index"),
        F.col("l_partkey").alias("ord"),
        tx.clock(F.col("l_quantity")).alias("timestamp"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("quote"),
        (F.col("l_discount") < 0.08).alias("verified"),
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as turns with word timings: 0.4 s per word, one more second after every twelfth word."""
    spoken = table(spark, sf, "conversations").where("role <> 'system'").select(
        F.col("conv_id").alias("call_id"),
        "turn",
        F.when(F.col("role") == "user", "customer").otherwise("agent").alias("speaker"),
        "text",
    )
    spoken = computed_once(spoken, _w=tx.words(F.col("text")))
    gap = F.when(F.col("turn") % 3 == 0, 300).when(F.col("turn") % 3 == 1, -900).otherwise(1500)
    step = 400 * F.size("_w") + gap
    placed = running_totals(
        spoken, ["call_id"], [F.col("turn")], index_block(F.col("turn"), 64), {"_i": F.lit(1), "_ms": step}
    ).withColumn("_start", F.col("_ms") - step)
    offset = lambda i: F.col("_start") + 400 * i + 1000 * F.floor(i / 12)
    words = F.transform(
        "_w",
        lambda w, i: F.struct(
            w.alias("text"), (offset(i) / 1000).alias("start"), ((offset(i) + 350) / 1000).alias("end"), F.lit(1.0).alias("confidence")
        ),
    )
    last = F.size("_w") - 1
    return placed.select(
        "call_id",
        (F.col("_i") - 1).cast("int").alias("turn_index"),
        "speaker",
        (F.col("_start") / 1000).alias("start_seconds"),
        (F.when(last >= 0, offset(last) + 350).otherwise(F.col("_start")) / 1000).alias("end_seconds"),
        "text",
        words.alias("words"),
        F.lit(False).alias("overlapping"),
    )


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).select(
        "call_id", F.col("turn_index").alias("segment_no"), "speaker", F.col("start_seconds").alias("start"),
        F.col("end_seconds").alias("end"), "text", "words",
    )


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Event values per user as a score series in [-1, 1], every event."""
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("call_id"), tx.micros(F.col("ts")).alias("_at"), "event_id", "event_type", "value"
    )
    placed = running_totals(
        e, ["call_id"], [F.col("_at"), F.col("event_id")], F.floor(F.col("_at") / 86_400_000_000), {"_i": F.lit(1)}
    )
    return placed.select(
        "call_id",
        (F.col("_i") - 1).cast("int").alias("turn_index"),
        (F.least(F.col("value") / 50.0, F.lit(2.0)) - 1).alias("score"),
        (F.col("event_type") != "view").alias("substantive"),
        (F.col("event_id") % 4 != 3).alias("citable"),
    )


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON), "token string, valence double")


def judgments(spark: SparkSession, sf: str) -> DataFrame:
    return judgments_of(turns(spark, sf))


def judgments_of(spoken: DataFrame) -> DataFrame:
    """First customer turn is the intent, last turn the outcome, status by conversation id."""
    per = spoken.groupBy("call_id").agg(
        F.min(F.when(F.col("speaker") == "customer", F.struct("turn_index", "text"))).alias("_i"),
        F.max("turn_index").alias("resolution_turn_index"),
    )
    m = F.col("call_id") % 3
    return per.where(F.col("_i").isNotNull()).select(
        "call_id",
        tx.first_words(F.col("_i.text"), 5).alias("intent_label"),
        F.col("_i.turn_index").alias("intent_turn_index"),
        F.when(m == 0, "resolved").when(m == 1, "partial").otherwise("unresolved").alias("resolution_status"),
        "resolution_turn_index",
        F.concat(F.lit("asked: "), F.col("_i.text")).alias("summary"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def cluster_texts(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as cluster members; every ninth group is noise."""
    return documents(spark, sf).select(
        F.col("doc_id").alias("id"),
        "text",
        F.when(F.col("doc_id") % 9 != 8, F.col("doc_id") % 9).alias("cluster_id"),
    )
