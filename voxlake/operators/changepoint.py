"""Where a series changes its level and stays changed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake import fixed
from voxlake.functions.scan import index_block, running_totals, with_neighbours

WIDTH = 4096


def positions(series: DataFrame, width: int = WIDTH) -> DataFrame:
    """Number the points of each call from 0 and add length and running total. In: `call_id, turn_index, score`."""
    numbered = running_totals(
        series,
        ["call_id"],
        [F.col("turn_index")],
        index_block(F.col("turn_index"), width),
        {"_k": F.lit(1), "cum_score": F.col("score")},
    )
    sizes = series.groupBy("call_id").agg(F.count("*").alias("n"), F.sum("score").alias("total_score"))
    return numbered.join(sizes.hint("merge"), "call_id").withColumn("pos", F.col("_k") - 1).drop("_k")


def smooth(placed: DataFrame, width: int = WIDTH) -> DataFrame:
    """Centred mean of three, shrinking at the edges; series shorter than three stay as they are."""
    spread, window, own = with_neighbours(placed, ["call_id"], "pos", 1, width)
    mean = F.avg("score").over(window.rowsBetween(-1, 1))
    return (
        spread.withColumn("smoothed", F.when(F.col("n") < 3, F.col("score")).otherwise(mean))
        .where(own)
        .select(*placed.columns, "smoothed")
    )


def penalties(smoothed: DataFrame) -> DataFrame:
    spread = F.greatest(F.var_pop("smoothed"), F.lit(fixed.MIN_VARIANCE))
    return smoothed.groupBy("call_id").agg(
        (F.lit(fixed.PENALTY_SCALE) * spread * F.log(F.max("n").cast("double"))).alias("penalty")
    )


def best_breaks(values: np.ndarray, penalty: float, min_segment: int = fixed.MIN_SEGMENT) -> list[int]:
    """Break positions of the cheapest segmentation: squared error plus `penalty` per break.

    Exact optimal partitioning with pruned start candidates (Killick, Fearnhead & Eckley 2012). A start is dropped only
    once its rival may itself open a segment of the required length.
    """
    n = len(values)
    s1 = np.concatenate(([0.0], np.cumsum(values)))
    s2 = np.concatenate(([0.0], np.cumsum(values * values)))
    best = np.full(n + 1, np.inf)
    best[0] = -penalty
    back = np.zeros(n + 1, dtype=np.int64)
    starts = np.array([0], dtype=np.int64)
    dying: dict[int, np.ndarray] = {}
    for t in range(min_segment, n + 1):
        if t - min_segment in dying:
            starts = starts[~np.isin(starts, dying.pop(t - min_segment))]
        fresh = t - min_segment
        if fresh >= min_segment:
            starts = np.append(starts, fresh)
        total = s1[t] - s1[starts]
        price = best[starts] + (s2[t] - s2[starts]) - total * total / (t - starts)
        at = int(np.argmin(price))
        best[t], back[t] = price[at] + penalty, starts[at]
        beaten = starts[price > best[t] + 1e-12]
        if len(beaten):
            dying[t] = beaten
    cuts, t = [], n
    while t > 0:
        t = int(back[t])
        if t > 0:
            cuts.append(t)
    return cuts[::-1]


def breaks(smoothed: DataFrame, min_points: int = fixed.MIN_SERIES) -> DataFrame:
    """`(call_id, break_pos)`: the optimal breaks of each series of at least `min_points` points.

    The recurrence is sequential, so a series stays in one task, but it is streamed: rows arrive sorted in Arrow
    batches shared by many short calls, and only a few numbers per point of the current series are held.
    """
    kind = smoothed.schema["call_id"].dataType.simpleString()
    # A fixed number keeps this processor-bound stage from being merged into few tasks because its rows are small.
    tasks = int(smoothed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    priced = smoothed.join(penalties(smoothed).hint("merge"), "call_id").where(F.col("n") >= min_points)

    def segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held, price = None, [], 0.0

        def finish():
            cuts = best_breaks(np.concatenate(held), price) if held else []
            return pd.DataFrame({"call_id": [current] * len(cuts), "break_pos": np.array(cuts, dtype=np.int64)})

        for batch in batches:
            ids = batch["call_id"].to_numpy()
            scores = batch["smoothed"].to_numpy(dtype=float)
            prices = batch["penalty"].to_numpy(dtype=float)
            edges = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            done = []
            for lo, hi in zip([0, *edges], [*edges, len(ids)]):
                if lo == hi:
                    continue
                if held and ids[lo] != current:
                    done.append(finish())
                    held = []
                current, price = ids[lo], prices[lo]
                held.append(scores[lo:hi])
            done = [d for d in done if len(d)]
            if done:
                yield pd.concat(done, ignore_index=True)
        if held:
            last = finish()
            if len(last):
                yield last

    return (
        priced.select("call_id", "pos", "smoothed", "penalty")
        .repartition(tasks, "call_id")
        .sortWithinPartitions("call_id", "pos")
        .drop("pos")
        .mapInPandas(segment, f"call_id {kind}, break_pos bigint")
    )


def _described(placed: DataFrame, cuts: DataFrame) -> DataFrame:
    """Raw means before and after each break position."""
    at = placed.select(
        "call_id",
        F.col("pos").alias("break_pos"),
        "turn_index",
        ((F.col("cum_score") - F.col("score")) / F.nullif(F.col("pos"), F.lit(0))).alias("before_mean"),
        ((F.col("total_score") - F.col("cum_score") + F.col("score")) / (F.col("n") - F.col("pos"))).alias("after_mean"),
    )
    return cuts.join(at.hint("merge"), ["call_id", "break_pos"]).withColumn("delta", F.col("after_mean") - F.col("before_mean"))


def _largest(described: DataFrame, min_delta: float) -> DataFrame:
    best = described.groupBy("call_id").agg(
        F.max(
            F.struct(F.abs("delta").alias("size"), (-F.col("break_pos")).alias("first"), "turn_index", "before_mean", "after_mean", "delta")
        ).alias("_b")
    )
    return best.where(F.col("_b.size") >= min_delta).select(
        "call_id", "_b.turn_index", "_b.before_mean", "_b.after_mean", "_b.delta"
    )


def mood_shifts(series: DataFrame, min_delta: float = fixed.MIN_DELTA) -> DataFrame:
    """At most one row per call: the optimal break with the largest change of the raw mean."""
    placed = positions(series)
    return _largest(_described(placed, breaks(smooth(placed))), min_delta)


def single_split(series: DataFrame, min_delta: float = fixed.MIN_DELTA) -> DataFrame:
    """The one split with the largest difference of smoothed means; built from running totals only."""
    placed = smooth(positions(series))
    summed = running_totals(
        placed, ["call_id"], [F.col("pos")], index_block(F.col("pos"), WIDTH), {"cum_smoothed": F.col("smoothed")}
    )
    totals = placed.groupBy("call_id").agg(F.sum("smoothed").alias("total_smoothed"))
    n, b = F.col("n"), F.col("pos")
    before = (F.col("cum_smoothed") - F.col("smoothed")) / b
    after = (F.col("total_smoothed") - F.col("cum_smoothed") + F.col("smoothed")) / (n - b)
    candidates = (
        summed.join(totals.hint("merge"), "call_id")
        .where((n >= fixed.MIN_SERIES) & (b >= 2) & (b <= n - 2))
        .select("call_id", F.col("pos").alias("break_pos"), F.abs(after - before).alias("_gap"))
    )
    best = candidates.groupBy("call_id").agg(
        F.max(F.struct(F.round("_gap", 9).alias("gap"), (-F.col("break_pos")).alias("first"))).alias("_b")
    )
    kept = best.where(F.col("_b.gap") >= min_delta).select("call_id", (-F.col("_b.first")).alias("break_pos"))
    return _described(placed, kept).drop("break_pos")


def reportable_shifts(points: DataFrame) -> DataFrame:
    """Shifts worth reporting: found on substantive turns, for the worse, ending negative, in a quotable turn."""
    found = mood_shifts(points.where("substantive").select("call_id", "turn_index", "score"))
    citable = points.where("citable").select("call_id", "turn_index")
    return found.where((F.col("delta") <= 0) & (F.col("after_mean") <= fixed.SHIFT_NEGATIVE_FLOOR)).join(
        citable.hint("merge"), ["call_id", "turn_index"], "left_semi"
    )
