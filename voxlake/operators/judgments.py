"""Judgments (intent, resolution, summary) as data, whoever produced them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake import fixed
from voxlake.functions import text as tx
from voxlake.functions.once import computed_once, let
from voxlake.operators.turns import transcripts

PAYLOAD = (
    "intent struct<label:string,turn_id:variant>, resolution struct<status:string,turn_id:variant>, summary string"
)


def first_json_object(text: Column) -> Column:
    """The first suffix of `text` that opens a well-formed, non-empty JSON object; null when there is none."""
    # An object that is not empty opens with a brace and a quote, so most other braces are passed over unread.
    pieces = let(
        F.split(text, r"\{"),
        lambda c: F.zip_with(
            F.slice(c, 1, F.size(c) - 1),
            F.slice(c, 2, F.size(c)),
            lambda before, after: F.struct(F.length(before).alias("skip"), after.rlike(r'^\s*"').alias("opens")),
        ),
    )

    def step(acc: Column, piece: Column) -> Column:
        at = acc["at"] + piece["skip"]
        suffix = F.substring(text, at, F.length(text))
        found = F.when(acc["found"].isNotNull() | ~piece["opens"], acc["found"]).when(
            F.size(F.json_object_keys(suffix)) > 0, suffix
        )
        return F.struct((at + 1).alias("at"), found.alias("found"))

    start = F.struct(F.lit(1).alias("at"), F.lit(None).cast("string").alias("found"))
    return F.aggregate(pieces, start, step)["found"]


def _object_in(text: Column) -> Column:
    """The text itself if it is JSON, and then only an object; else the first object inside it."""
    # The parser stops after a value; as the one element of a list, the text has to be a value to its end.
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    whole = listed.isNotNull() & F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(~whole, first_json_object(text)).when(F.schema_of_variant(listed).startswith("ARRAY<OBJECT"), text)


def parse_payloads(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Add the parsed payload as `judgment` and an `error` text where no object could be read."""
    parsed = computed_once(raw, _json=_object_in(F.col(column)))
    return computed_once(parsed, judgment=F.from_json("_json", PAYLOAD)).withColumn(
        "error", F.when(F.col("_json").isNull(), F.lit("no JSON object found in model output"))
    ).drop("_json")


def _turn_id(raw: Column, n_turns: Column) -> Column:
    """A whole number in text, a number cut to its whole part, true as 1; anything else is 0. Clamped to the turns."""
    kind, text = F.schema_of_variant(raw), F.try_variant_get(raw, "$", "string")
    number = (
        F.when(kind == "STRING", F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("decimal(38,0)")))
        .when(kind == "BOOLEAN", F.try_variant_get(raw, "$", "boolean").cast("int").cast("decimal(38,0)"))
        .otherwise(text.try_cast("double").try_cast("bigint").cast("decimal(38,0)"))
    )
    clamped = F.greatest(F.lit(0), F.least(number, n_turns - 1))
    return F.when(number.isNull(), 0).otherwise(clamped).cast("int")


def clamp_summary(summary: Column, limit: int = fixed.MAX_SUMMARY_WORDS) -> Column:
    def cut(ws: Column) -> Column:
        head = F.regexp_replace(F.array_join(F.slice(ws, 1, limit), " "), "[,;:]+$", "")
        return F.when(F.size(ws) <= limit, tx.strip(summary)).otherwise(F.concat(head, F.lit("…")))

    return let(tx.words(summary), cut)


def coerce(parsed: DataFrame, turn_counts: DataFrame) -> DataFrame:
    """Check parsed judgments against the transcript: clamp turn numbers, fix unknown status and blank label."""
    j = F.col("judgment")
    status = F.lower(tx.strip(j["resolution"]["status"]))
    joined = parsed.join(turn_counts.hint("merge"), "call_id")
    return joined.select(
        "call_id",
        *[c for c in parsed.columns if c in ("judge", "analyzed_at")],
        F.coalesce(F.nullif(tx.strip(j["intent"]["label"]), F.lit("")), F.lit("unclear")).alias("intent_label"),
        _turn_id(j["intent"]["turn_id"], F.col("n_turns")).alias("intent_turn_index"),
        F.when(status.isin(list(fixed.RESOLUTIONS)), status).otherwise("unresolved").alias("resolution_status"),
        _turn_id(j["resolution"]["turn_id"], F.col("n_turns")).alias("resolution_turn_index"),
        clamp_summary(F.coalesce(tx.strip(j["summary"]), F.lit(""))).alias("summary"),
    )


def turn_counts(turns: DataFrame) -> DataFrame:
    return turns.groupBy("call_id").agg(F.count("*").alias("n_turns"))


def rule_judge(turns: DataFrame) -> DataFrame:
    """A deterministic judge: first customer turn is the intent, last turn the outcome, status by fixed patterns."""
    spoken = turns.groupBy("call_id").agg(
        F.min(F.when(F.col("speaker") == "customer", F.struct("turn_index", "text"))).alias("_i"),
        F.max("turn_index").alias("_l"),
        F.max(F.when((F.col("speaker") == "agent") & F.col("text").rlike(fixed.AGENT_CLAIM), F.col("turn_index"))).alias("_claim"),
        F.max(F.when((F.col("speaker") == "customer") & F.col("text").rlike(fixed.CUSTOMER_PUSHBACK), F.col("turn_index"))).alias("_push"),
    )
    label = F.coalesce(tx.first_words(F.col("_i.text"), 5), F.lit(""))
    status = (
        F.when(F.col("_push").isNotNull() & (F.col("_push") > F.coalesce(F.col("_claim"), F.lit(-1))), "unresolved")
        .when(F.col("_claim").isNotNull(), "resolved")
        .otherwise("partial")
    )
    payload = F.to_json(
        F.struct(
            F.struct(label.alias("label"), F.coalesce(F.col("_i.turn_index"), F.lit(0)).alias("turn_id")).alias("intent"),
            F.struct(status.alias("status"), F.col("_l").alias("turn_id")).alias("resolution"),
            F.concat(F.lit("Customer: "), label, F.lit(". Outcome: "), status).alias("summary"),
        )
    )
    return spoken.select("call_id", payload.alias("payload"))


def model_judge(model: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """A judge from a string-to-string column function, e.g. a pandas UDF that calls a model: it reads each call whole."""

    def judge(turns: DataFrame) -> DataFrame:
        return transcripts(turns, part_turns=None).select("call_id", model(F.col("transcript")).alias("payload"))

    return judge


def attach_judgments(turns: DataFrame, judge: Callable[[DataFrame], DataFrame] | DataFrame = rule_judge) -> tuple[DataFrame, DataFrame]:
    """`(judgments, errors)`: one judgment per readable payload; unreadable ones never fail the batch.

    `judge` is a function of the turns or a ready table, giving `call_id, payload`.
    """
    payloads = judge if isinstance(judge, DataFrame) else judge(turns)
    parsed = parse_payloads(payloads)
    good = parsed.where(F.col("error").isNull())
    bad = parsed.where(F.col("error").isNotNull()).select("call_id", "error")
    return coerce(good, turn_counts(turns)), bad
