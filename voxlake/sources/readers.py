"""Readers: call metadata, transcripts, speech-recognition output, reference texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake import schemas
from voxlake.functions import text as tx

NO_SPEECH = 0.6  # Fixed value: segments more likely silent than this are dropped.


def call_metadata(raw: DataFrame) -> DataFrame:
    """Nested metadata to flat call rows. A missing id, name or time fails the job instead of passing as null."""
    customer = F.col("caller.metadata").getField("first and last name")
    agent = F.col("agent.metadata.agent_name")

    def required(value: Column, name: str) -> Column:
        return F.when(
            F.assert_true(value.isNotNull(), F.lit(f"call metadata without {name}")).isNull(), value
        )

    start, end = F.col("start_time_ms"), F.col("end_time_ms")
    named = raw.select(
        required(F.col("sid"), "sid").alias("call_id"),
        required(customer, "first and last name").alias("customer_name"),
        required(agent, "agent_name").alias("agent_name"),
        F.timestamp_millis(required(start, "start_time_ms")).alias("started_at"),
        ((required(end, "end_time_ms") - start) / 1000.0).alias("duration_seconds"),
        "session",
        F.col("labels.caller_mos").alias("caller_mos"),
        F.col("labels.agent_mos").alias("agent_mos"),
    )
    return named.select(
        "call_id",
        tx.slug(F.col("customer_name")).alias("customer_id"),
        "customer_name",
        tx.slug(F.col("agent_name")).alias("agent_id"),
        "agent_name",
        "started_at",
        F.to_date("started_at").alias("call_date"),
        "duration_seconds",
        "session",
        "caller_mos",
        "agent_mos",
    )


def read_call_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per file."""
    return call_metadata(spark.read.schema(schemas.CALL_METADATA).option("multiLine", True).json(path))


def with_audio(calls: DataFrame, spark: SparkSession, audio_path: str, suffix: str = ".mp3", limit: int | None = None) -> DataFrame:
    """Calls that also have an audio file, by call id. Only the file listing is read."""
    listing = (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(audio_path).select("path")
    )
    stem = F.regexp_extract("path", r"([^/]+)" + suffix.replace(".", r"\.") + "$", 1)
    found = calls.join(listing.select(stem.alias("call_id")), "call_id", "left_semi")
    return found if limit is None else found.orderBy("call_id").limit(limit)


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """`(segments, quarantined files)`. Unreadable files are listed, never removed."""
    raw = (
        spark.read.schema(schemas.TRANSCRIPT)
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
        .withColumn("file", F.col("_metadata.file_path"))
    )
    broken = F.col("_corrupt_record").isNotNull() | F.col("call_id").isNull() | F.col("segments").isNull()
    return transcript_segments(raw.where(~broken)), raw.where(broken).select("file", "_corrupt_record")


def transcript_segments(transcripts: DataFrame) -> DataFrame:
    flat = transcripts.select("call_id", "provider", F.posexplode("segments").alias("segment_no", "_s"))
    return flat.select("call_id", "provider", "segment_no", "_s.*")


def multichannel_segments(raw: DataFrame) -> DataFrame:
    """Utterances with a channel number to segments: 1 agent, 2 customer, else by speaker label. Times in ms.

    `channel_fallback` marks rows whose channel was present but unknown.
    """
    flat = raw.select("call_id", F.posexplode("utterances").alias("segment_no", "_u")).select("call_id", "segment_no", "_u.*")
    channel = F.trim("channel").try_cast("int")
    label = F.upper(F.trim(F.coalesce("speaker", F.lit(""))))
    by_label = F.when(label.isin("A", "1"), "agent").otherwise("customer")
    words = F.transform(
        F.coalesce("words", F.array().cast("array<struct<text:string,start:bigint,end:bigint,confidence:double>>")),
        lambda w: F.struct(
            w["text"].alias("text"),
            (w["start"] / 1000).alias("start"),
            (w["end"] / 1000).alias("end"),
            F.coalesce(w["confidence"], F.lit(1.0)).alias("confidence"),
        ),
    )
    return flat.select(
        "call_id",
        "segment_no",
        F.when(channel == 1, "agent").when(channel == 2, "customer").otherwise(by_label).alias("speaker"),
        (F.col("start") / 1000).alias("start"),
        (F.col("end") / 1000).alias("end"),
        "text",
        words.alias("words"),
        (F.col("channel").isNotNull() & ~F.coalesce(channel.isin(1, 2), F.lit(False))).alias("channel_fallback"),
    )


def channel_fallbacks(segments: DataFrame) -> DataFrame:
    return segments.agg(F.count("*").alias("segments"), F.count_if("channel_fallback").alias("channel_fallbacks"))


def per_channel_segments(raw: DataFrame, threshold: float = NO_SPEECH) -> DataFrame:
    """Per-channel recogniser output to segments, without likely silence and blank text."""
    flat = raw.select("call_id", "speaker", F.posexplode("segments").alias("segment_no", "_s")).select(
        "call_id", "speaker", "segment_no", "_s.*"
    )
    words = F.transform(
        F.coalesce("words", F.array().cast("array<struct<word:string,start:double,end:double,probability:double>>")),
        lambda w: F.struct(
            tx.strip(w["word"]).alias("text"), w["start"].alias("start"), w["end"].alias("end"), w["probability"].alias("confidence")
        ),
    )
    spoken = F.coalesce(F.col("no_speech_prob"), F.lit(0.0)) <= threshold
    return flat.where(spoken & (tx.strip(F.col("text")) != "")).select(
        "call_id", "segment_no", "speaker", "start", "end", tx.strip(F.col("text")).alias("text"), words.alias("words")
    )


def channel_quality(calls: DataFrame, segments: DataFrame) -> DataFrame:
    """Per call: `error` when neither channel has speech, `warning` when one is empty, else `ok`."""
    sides = segments.groupBy("call_id").agg(
        F.count_if(F.col("speaker") == "agent").alias("agent_segments"),
        F.count_if(F.col("speaker") == "customer").alias("customer_segments"),
    )
    a, c = F.coalesce("agent_segments", F.lit(0)), F.coalesce("customer_segments", F.lit(0))
    return calls.select("call_id").distinct().join(sides, "call_id", "left").select(
        "call_id",
        a.alias("agent_segments"),
        c.alias("customer_segments"),
        F.when((a == 0) & (c == 0), "error").when((a == 0) | (c == 0), "warning").otherwise("ok").alias("quality"),
    )


def read_reference_texts(spark: SparkSession, path: str) -> DataFrame:
    """`{call_id}.txt` files, each as one row."""
    raw = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return raw.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("call_id"), F.col("value").alias("reference")
    )
