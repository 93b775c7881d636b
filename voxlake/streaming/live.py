"""Calls that arrive one by one: the batch functions, run per micro-batch."""

from __future__ import annotations

from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from voxlake import schemas
from voxlake.functions import text as tx
from voxlake.functions.scan import added_counts, median_of_counts, value_counts
from voxlake.operators import judgments, mood, repeats
from voxlake.operators.evidence import Support
from voxlake.operators.turns import build_turns
from voxlake.plans.analysis import analyse, rescore
from voxlake.session import settle
from voxlake.sources.snapshots import Snapshots
from voxlake.sources.tables import read_or_empty, upsert_dimension

INCOMING = (
    "call_id string, customer_name string, agent_name string, started_at timestamp, duration_seconds double, "
    "provider string, "
    f"segments array<struct<speaker:string,start:double,end:double,text:string,words:array<{schemas.WORD}>>>"
)
LIVE_CALLS = (
    "call_id string, customer_id string, customer_name string, agent_id string, agent_name string, "
    "started_at timestamp, duration_seconds double, session string, intent_label string, resolution_status string, "
    "summary string, attention_score int, repeat_count int"
)
PARTS = "batch_id bigint, bucket int"
CORRECTIONS = f"call_id string, repeat_count int, attention_score int, {PARTS}"
#: Stored calls and ids lie in so many folders by customer and by id; a batch reads those it touches.
BUCKETS = 256


def with_defaults(incoming: DataFrame) -> DataFrame:
    """Fill what a live call may lack: an id, a start time, the session name."""
    return incoming.select(
        F.coalesce("call_id", F.uuid()).alias("call_id"),
        tx.slug(F.coalesce("customer_name", F.lit(""))).alias("customer_id"),
        tx.strip(F.col("customer_name")).alias("customer_name"),
        tx.slug(F.coalesce("agent_name", F.lit(""))).alias("agent_id"),
        tx.strip(F.col("agent_name")).alias("agent_name"),
        F.coalesce("started_at", F.current_timestamp()).alias("started_at"),
        "duration_seconds",
        F.lit("ingested").alias("session"),
        "segments",
    )


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(key), F.lit(""))), F.lit(BUCKETS)).cast("int")


def touched(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows of the buckets that `rows` fall into; other folders are not listed as input."""
    wanted = [r[0] for r in rows.select(bucket_of(key)).distinct().collect()]  # at most BUCKETS numbers
    return table.where(F.col("bucket").isin(wanted))


def duration_counts(spark: SparkSession, root: str, batch_id: int, calls: DataFrame) -> DataFrame:
    """`(value, n)` of all handle times up to this batch: one row per distinct duration, kept from batch to batch.

    The counts and the number of the last batch in them are committed as one state, so a batch that is replayed is not
    counted twice.
    """
    store = Snapshots(spark, root)
    state = store.current()
    fresh = value_counts(calls, "duration_seconds")
    if state is not None:
        if state.read(spark, "progress").first()["batch_id"] >= batch_id:
            return state.read(spark, "durations")
        fresh = added_counts(state.read(spark, "durations"), fresh)
    done = store.commit({"durations": fresh, "progress": spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch_id"))}, state)
    store.clean(keep=2)
    return done.read(spark, "durations")


def ingest_batch(
    spark: SparkSession, batch: DataFrame, batch_id: int, root: str, lexicon: DataFrame, judge: Any, support: Support
) -> None:
    """Analyse the new calls of one micro-batch and append them.

    A call already stored is skipped, and a replayed batch overwrites its own folders, so each call is stored once.
    Repeat contact counts stored history and this batch. A late call changes the counts of stored calls that came after it:
    these are scored again and appended to `corrections`; `current_scores` reads the newest. History is read by bucket, and
    the median handle time comes from counts of distinct durations.
    """
    folder = PurePosixPath(root)
    table = lambda name, schema: read_or_empty(spark, str(folder / name), schema).where(F.col("batch_id") != batch_id)
    filled = with_defaults(batch).dropDuplicates(["call_id"])
    seen = touched(table("seen", f"call_id string, {PARTS}"), filled.where("call_id is not null"), "call_id")
    # Written once before use: generated ids and times must not change between the stages below.
    fresh = filled.join(seen.select("call_id"), "call_id", "left_anti")
    landing = str(folder / "landing" / f"batch_id={batch_id}")
    fresh.write.mode("overwrite").parquet(landing)
    calls = spark.read.parquet(landing)
    if calls.isEmpty():
        return
    segments = calls.select("call_id", F.posexplode("segments").alias("segment_no", "_s")).select(
        "call_id", "segment_no", "_s.*"
    )
    turns = settle(build_turns(segments))
    customers = calls.select("customer_id").distinct()
    stored = touched(table("calls", f"{LIVE_CALLS}, {PARTS}"), customers, "customer_id")
    earlier = settle(stored.join(customers, "customer_id", "left_semi"))
    median = settle(median_of_counts(duration_counts(spark, str(folder / "durations"), batch_id, calls), "median_duration"))
    done = analyse(calls, turns, lexicon, judge, support=support, history=earlier, corpus=median)
    judged = calls.drop("segments").join(
        done.judged.select("call_id", "intent_label", "resolution_status", "summary"), "call_id", "left"
    )
    slim = lambda df: df.select("call_id", "customer_id", "started_at", "intent_label")
    counts = settle(recount(slim(judged).unionByName(slim(earlier))))
    rows = judged.join(done.attention.select("call_id", "attention_score"), "call_id", "left").join(counts, "call_id", "left")

    def save(df: DataFrame, name: str, *parts: str) -> None:
        df.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(*parts, "batch_id").parquet(str(folder / name))

    # Calls stored before whose count this batch has changed, and what was kept of them.
    corrected = touched(table("corrections", CORRECTIONS), customers, "customer_id")
    newest = corrected.groupBy("call_id").agg(F.max_by("repeat_count", "batch_id").alias("last"))
    new_count = counts.withColumnRenamed("repeat_count", "new_count")
    changed = settle(
        earlier.join(newest, "call_id", "left").join(new_count, "call_id")
        .where(F.col("new_count") != F.coalesce("last", "repeat_count"))
        .select("call_id", "customer_id", "batch_id", "duration_seconds", "resolution_status", F.col("new_count").alias("repeat_count"))
    )
    if not changed.isEmpty():
        keys = changed.select("batch_id", "call_id")
        kept = lambda df, name: table(name, StructType([*df.schema.fields, StructField("batch_id", LongType())])).join(keys, ["batch_id", "call_id"], "left_semi").drop("batch_id")
        again, cited = rescore(
            changed.drop("repeat_count"), settle(kept(turns, "turns")), settle(kept(done.points, "mood_points")),
            kept(done.evidence, "evidence"), None, support, earlier=changed.select("call_id", "repeat_count"), corpus=median,
        )
        by_customer = changed.select("call_id", "repeat_count", bucket_of("customer_id").alias("bucket"))
        save(by_customer.join(again.select("call_id", "attention_score", "factors"), "call_id", "left"), "corrections", "bucket")
        save(cited, "corrected_evidence")

    for name, key, shown in (("customers", "customer_id", "customer_name"), ("agents", "agent_id", "agent_name")):
        known = table(name, f"{key} string, {shown} string, batch_id bigint")
        save(upsert_dimension(known, calls.select(key, shown, "started_at"), key, "started_at"), name)
    save(turns, "turns")
    save(done.points, "mood_points")
    save(done.evidence, "evidence")
    save(done.attention, "attention")
    save(done.errors, "errors")
    save(rows.withColumn("bucket", bucket_of("customer_id")), "calls", "bucket")
    # Last: a call counts as stored only when everything else is.
    save(calls.select("call_id", bucket_of("call_id").alias("bucket")), "seen", "bucket")


def current_scores(spark: SparkSession, root: str) -> DataFrame:
    """`(call_id, repeat_count, attention_score)` of all stored calls, with what late calls have changed since."""
    calls = read_or_empty(spark, str(PurePosixPath(root) / "calls"), f"{LIVE_CALLS}, {PARTS}")
    corrected = read_or_empty(spark, str(PurePosixPath(root) / "corrections"), CORRECTIONS)
    columns = ["call_id", "batch_id", "repeat_count", "attention_score"]
    newest = F.max_by(F.struct("repeat_count", "attention_score"), "batch_id").alias("_n")
    return calls.select(*columns).unionByName(corrected.select(*columns)).groupBy("call_id").agg(newest).select("call_id", "_n.*")


def ingest_stream(
    spark: SparkSession,
    source: str,
    root: str,
    judge: Any = judgments.rule_judge,
    lexicon: DataFrame | None = None,
    support: Support = Support(),
    available_now: bool = True,
) -> StreamingQuery:
    """Watch a folder of call files (one JSON object per line) and store their analysis under `root`."""
    words = lexicon if lexicon is not None else mood.default_lexicon(spark)
    stream = spark.readStream.schema(INCOMING).json(source)
    writer = stream.writeStream.option("checkpointLocation", str(PurePosixPath(root) / "progress")).foreachBatch(
        lambda batch, batch_id: ingest_batch(batch.sparkSession, batch, batch_id, root, words, judge, support)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def recount(stored: DataFrame) -> DataFrame:
    """Repeat counts of the given calls, by customer and intent."""
    return repeats.prior_same_intent(stored)


def daily_counts(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Calls per day from a stream; late calls are counted for as long as the watermark allows."""
    return (
        stream.withWatermark("started_at", delay)
        .groupBy(F.window("started_at", "1 day"))
        .agg(F.count("*").alias("call_count"))
        .select(F.to_date("window.start").alias("call_date"), "call_count")
    )
