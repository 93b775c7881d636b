"""From speaker-tagged segments to numbered turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake import fixed
from voxlake.functions import text as tx
from voxlake.functions.once import computed_once
from voxlake.functions.scan import running_totals

BLOCK_SECONDS = 900.0


def split_on_pauses(segments: DataFrame, gap: float = fixed.TURN_GAP) -> DataFrame:
    """Cut each segment where consecutive words are more than `gap` seconds apart.

    Works inside the words array of each row, so nothing is shuffled. Segments with fewer than two timed words pass
    through. In: `call_id, segment_no, speaker, start, end, text, words`. Adds `piece_no`.
    """
    words = F.col("words")
    n = F.size(words)
    segments = computed_once(
        segments,
        _breaks=F.when(
            n >= 2,
            F.filter(
                F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                lambda i: F.get(words, i)["start"] - F.get(words, i - 1)["end"] > gap,
            ),
        ),
    )
    breaks = F.col("_breaks")
    firsts = F.concat(F.array(F.lit(0)), breaks)
    nexts = F.concat(breaks, F.array(n))

    def piece(first: Column, after: Column) -> Column:
        part = F.slice(words, first + 1, after - first)
        return F.struct(
            F.get(words, first)["start"].alias("start"),
            F.get(words, after - 1)["end"].alias("end"),
            tx.strip(F.array_join(F.transform(part, lambda w: tx.strip(w["text"])), " ")).alias("text"),
            part.alias("words"),
        )

    whole = F.array(F.struct("start", "end", "text", F.coalesce(words, F.array().cast("array<struct<text:string,start:double,end:double,confidence:double>>")).alias("words")))
    pieces = F.when(breaks.isNull(), whole).otherwise(F.zip_with(firsts, nexts, piece))
    return segments.select(
        "call_id", "segment_no", "speaker", F.posexplode(pieces).alias("piece_no", "_p")
    ).select("call_id", "segment_no", "piece_no", "speaker", "_p.start", "_p.end", "_p.text", "_p.words")


def merge_into_turns(
    pieces: DataFrame, gap: float = fixed.TURN_GAP, block_seconds: float = BLOCK_SECONDS
) -> DataFrame:
    """Join neighbouring pieces of one speaker into turns, number them, flag crosstalk.

    Pieces are ordered by start (agent first on ties). A piece continues the current turn when the speaker is the same
    and it starts at most `gap` after the latest end so far. Where the speaker changes before the previous turn has
    ended, both turns are flagged and kept apart.

    A call is processed in time blocks. What a block needs from the past is its last speaker and the latest end of that
    speaker's unbroken run, which one small row per block carries forward.
    """
    blocked = pieces.withColumn("_block", F.floor(F.col("start") / block_seconds))
    order = ["start", "speaker", "segment_no", "piece_no"]  # "agent" sorts before "customer"
    inside = Window.partitionBy("call_id", "_block").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    switch = F.coalesce((F.col("speaker") != F.lag("speaker").over(inside)).cast("int"), F.lit(0))
    runs = blocked.withColumn("_switch", switch).withColumn("_run", F.sum("_switch").over(upto))
    in_run = (
        Window.partitionBy("call_id", "_block", "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    runs = runs.withColumn("_reach", F.max("end").over(in_run))

    summary = runs.groupBy("call_id", "_block").agg(
        F.min(F.struct("_run", "start", "speaker")).alias("_first"),
        F.max(F.struct("_run", "end", "speaker")).alias("_last"),
    )
    by_block = Window.partitionBy("call_id").orderBy("_block")
    summary = summary.withColumn(
        "_fresh",
        F.coalesce(
            (
                (F.col("_last._run") > 0) | (F.col("_first.speaker") != F.lag("_last.speaker").over(by_block))
            ).cast("int"),
            F.lit(1),
        ),
    ).withColumn("_chain", F.sum("_fresh").over(by_block))
    in_chain = Window.partitionBy("call_id", "_chain").orderBy("_block")
    summary = summary.withColumn("_tail", F.max("_last.end").over(in_chain))
    carry = summary.select(
        "call_id",
        "_block",
        F.lag("_last.speaker").over(by_block).alias("_c_speaker"),
        F.lag("_tail").over(by_block).alias("_c_reach"),
        F.lead("_first.speaker").over(by_block).alias("_n_speaker"),
        F.lead("_first.start").over(by_block).alias("_n_start"),
    )

    rows = runs.join(carry, ["call_id", "_block"], "left")
    rows = rows.withColumn(
        "_reach",
        F.when(
            (F.col("_run") == 0) & (F.col("speaker") == F.col("_c_speaker")), F.greatest("_reach", "_c_reach")
        ).otherwise(F.col("_reach")),
    )
    previous_speaker = F.coalesce(F.lag("speaker").over(inside), F.col("_c_speaker"))
    previous_end = F.coalesce(F.lag("_reach").over(inside), F.col("_c_reach"))
    next_speaker = F.coalesce(F.lead("speaker").over(inside), F.col("_n_speaker"))
    next_start = F.coalesce(F.lead("start").over(inside), F.col("_n_start"))
    rows = (
        rows.withColumn("_ps", previous_speaker)
        .withColumn("_pe", previous_end)
        .withColumn("_ns", next_speaker)
        .withColumn("_nst", next_start)
        .withColumn(
            "_new",
            F.when(F.col("_ps").isNull(), 1)
            .when((F.col("_ps") == F.col("speaker")) & (F.col("start") - F.col("_pe") <= gap), 0)
            .otherwise(1),
        )
        .withColumn(
            "_over",
            F.coalesce((F.col("_ps") != F.col("speaker")) & (F.col("start") < F.col("_pe")), F.lit(False))
            | F.coalesce((F.col("_ns") != F.col("speaker")) & (F.col("_nst") < F.col("_reach")), F.lit(False)),
        )
    )
    slim = rows.select(*pieces.columns, "_block", "_new", "_over")
    numbered = running_totals(
        slim.withColumnRenamed("_block", "_b"),
        ["call_id"],
        [F.col(c) for c in order],
        F.col("_b"),
        {"_turn": F.col("_new")},
    )
    ordered = F.sort_array(F.collect_list(F.struct(*order, "text", "words")))
    merged = numbered.groupBy("call_id", (F.col("_turn") - 1).cast("int").alias("turn_index")).agg(
        F.first("speaker").alias("speaker"),
        F.min("start").alias("start_seconds"),
        F.max("end").alias("end_seconds"),
        ordered.alias("_parts"),
        F.max("_over").alias("overlapping"),
    )
    return merged.select(
        "call_id",
        "turn_index",
        "speaker",
        "start_seconds",
        "end_seconds",
        tx.strip(
            F.array_join(F.filter(F.col("_parts.text"), lambda t: tx.strip(t) != ""), " ")
        ).alias("text"),
        F.flatten(F.col("_parts.words")).alias("words"),
        "overlapping",
    )


def build_turns(
    segments: DataFrame,
    gap: float = fixed.TURN_GAP,
    block_seconds: float = BLOCK_SECONDS,
    stage: Callable[[str, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Segments to turns. Merging reads its pieces several times, each time a few columns: pass `stage` (for example
    `sources.tables.table_stage`) to write them once to a columnar table first."""
    pieces = split_on_pauses(segments, gap)
    return merge_into_turns(stage("pieces", pieces) if stage else pieces, gap, block_seconds)


def swapped_calls(turns: DataFrame, pattern: str = fixed.GREETING) -> DataFrame:
    """Calls whose opening script was heard on the customer's channel."""
    return (
        turns.where((F.col("turn_index") == 0) & (F.col("speaker") == "customer") & F.col("text").rlike(pattern))
        .select("call_id")
        .distinct()
    )


def flip_speakers(turns: DataFrame, swapped: DataFrame) -> DataFrame:
    marked = turns.join(swapped.select("call_id", F.lit(True).alias("_swap")), "call_id", "left")
    other = F.when(F.col("speaker") == "agent", "customer").otherwise("agent")
    return marked.withColumn("speaker", F.when(F.col("_swap"), other).otherwise(F.col("speaker"))).select(*turns.columns)


def transcript_lines(turns: DataFrame) -> DataFrame:
    """One numbered line per turn: `[i] MM:SS speaker: text`."""
    s = F.col("start_seconds")
    line = F.format_string(
        "[%d] %02d:%02d %s: %s",
        F.col("turn_index").cast("bigint"),
        F.floor(s / 60),
        F.floor(s % 60),
        F.col("speaker"),
        F.col("text"),
    )
    return turns.select("call_id", "turn_index", line.alias("line"))


def transcripts(turns: DataFrame, part_turns: int | None = 2000) -> DataFrame:
    """Whole transcripts as text, `part_turns` turns per row so that no row grows without bound; None: a call in one row."""
    part = F.lit(0) if part_turns is None else F.floor(F.col("turn_index") / part_turns).cast("int")
    grouped = transcript_lines(turns).groupBy("call_id", part.alias("part"))
    lines = F.sort_array(F.collect_list(F.struct("turn_index", "line")))
    return grouped.agg(F.array_join(lines["line"], "\n").alias("transcript"), F.count("*").alias("n_turns"))


def turn_at(turns: DataFrame, moments: DataFrame, width: float = 60.0) -> DataFrame:
    """The turn playing at each `(call_id, t)`: start <= t < end, matched through time buckets of `width` seconds."""
    spans = turns.select(
        "call_id",
        "turn_index",
        "start_seconds",
        "end_seconds",
        F.explode(
            F.sequence(F.floor(F.col("start_seconds") / width), F.floor(F.col("end_seconds") / width))
        ).alias("_bucket"),
    )
    asked = moments.withColumn("_bucket", F.floor(F.col("t") / width))
    hit = (F.col("t") >= F.col("start_seconds")) & (F.col("t") < F.col("end_seconds"))
    return asked.join(spans, ["call_id", "_bucket"]).where(hit).select("call_id", "t", "turn_index")
