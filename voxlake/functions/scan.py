"""Ordered computations inside a key that stay parallel when one key holds much of the data.

A plain `Window.partitionBy(key)` puts a whole key into one task. Here every key is cut into blocks along its own
order; windows run inside `(key, block)`, the small per-block totals are carried forward per key, and the carry is
joined back. The main shuffle is on `(key, block)`; only one row per block takes part in the second one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"


def index_block(index: Column, width: int) -> Column:
    return F.floor(index / F.lit(width))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    block: Column,
    totals: Mapping[str, Column],
    before: bool = False,
) -> DataFrame:
    """Add running sums of `totals` per key.

    `block` must not decrease along `order`. Rows are summed up to and including the current row; with `before` only
    rows whose first order value is strictly smaller count (a range frame, so ties see the same total).
    """
    tagged = df.withColumn(BLOCK, block)
    for name, value in totals.items():
        tagged = tagged.withColumn(f"_v_{name}", value)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    frame = (
        inside.rangeBetween(Window.unboundedPreceding, -1)
        if before
        else inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = tagged.select(
        "*", *[F.sum(f"_v_{n}").over(frame).alias(f"_in_{n}") for n in totals]
    )
    sums = tagged.groupBy(*keys, BLOCK).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in totals])
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(
        *keys, BLOCK, *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in totals]
    )
    # The rows are dealt and sorted by key and block already. The size of the carry, one row a block, is a guess, so it is not
    # sent through the driver.
    joined = local.join(carry.hint("merge"), [*keys, BLOCK], "left")
    return joined.select(
        *df.columns,
        *[
            (F.coalesce(F.col(f"_in_{n}"), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n)
            for n in totals
        ],
    )


def with_neighbours(df: DataFrame, keys: Sequence[str], index: str, reach: int, width: int = 4096) -> tuple[DataFrame, Window, Column]:
    """Rows plus copies of those near a block edge, a window over `(keys, block)`, and the flag of original rows.

    For frames that look at most `reach` rows away over a gap-free `index`.
    """
    own = index_block(F.col(index), width)
    blocks = F.array_distinct(
        F.array(index_block(F.col(index) - reach, width), own, index_block(F.col(index) + reach, width))
    )
    spread = df.select("*", F.explode(blocks).alias(BLOCK), own.alias("_own"))
    return spread, Window.partitionBy(*keys, BLOCK).orderBy(index), F.col(BLOCK) == F.col("_own")


def exact_median(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "median") -> DataFrame:
    """Exact, interpolated median per key (or over everything when `keys` is empty).

    A mergeable sketch brackets the middle; rows outside the bracket collapse to two counts, rows inside are counted
    per distinct value, so only a thin slice around the middle is ever sorted, and that in blocks.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sketch = F.percentile_approx("_v", [0.49, 0.51], F.lit(1000))
    stats = rows.groupBy(*keys).agg(F.count("*").alias("_n"), sketch.alias("_b"))
    if keys:
        bracketed = rows.join(stats.hint("merge"), keys)
    else:
        one = stats.select(F.struct("_n", "_b").alias("_s"))
        bracketed = rows.withColumn("_s", one.scalar()).select("*", "_s._n", "_s._b")
    lo, hi = F.col("_b")[0], F.col("_b")[1]
    slot = (
        F.when(F.col("_v") < lo, F.lit(float("-inf")))
        .when(F.col("_v") > hi, F.lit(float("inf")))
        .otherwise(F.col("_v"))
    )
    counts = bracketed.groupBy(*keys, slot.alias("_v")).agg(
        F.count("*").alias("_k"), F.first("_n").alias("_n"), F.first("_b").alias("_b")
    )
    # The slice itself is ranked in 1,024 blocks by value.
    part = F.floor((F.col("_v") - lo) / F.nullif(hi - lo, F.lit(0.0)) * 1024)
    block = (
        F.when(F.col("_v") == F.lit(float("-inf")), -1)
        .when(F.col("_v") == F.lit(float("inf")), 1025)
        .otherwise(F.coalesce(part, F.lit(0)))
    )
    ranked = running_totals(counts, keys, [F.col("_v")], block, {"_cum": F.col("_k")})
    lower = F.min(F.when(F.col("_cum") >= F.floor((F.col("_n") + 1) / 2), F.col("_v")))
    upper = F.min(F.when(F.col("_cum") >= F.floor(F.col("_n") / 2) + 1, F.col("_v")))
    return ranked.groupBy(*keys).agg(((lower + upper) / 2).alias(name))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """`(value, n)`: how often each value occurs; nulls are left out. Such counts are added up, not read again."""
    return df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))


def added_counts(*counts: DataFrame) -> DataFrame:
    """The counts of several parts together."""
    rows = counts[0]
    for more in counts[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("value").agg(F.sum("n").alias("n"))


def median_of_counts(counts: DataFrame, name: str = "median", blocks: int = 1024) -> DataFrame:
    """One row: the exact, interpolated median of what `(value, n)` stands for; null if that is nothing.

    Values are ranked in blocks of their range, so no task sorts all of them.
    """
    ends = counts.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("all")).alias("_e"))
    rows = counts.withColumn("_e", ends.scalar()).select("value", "n", "_e.lo", "_e.hi", "_e.all")
    block = F.coalesce(F.floor((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * blocks), F.lit(0))
    ranked = running_totals(rows, [], [F.col("value")], block, {"_cum": F.col("n")})
    lower = F.min(F.when(F.col("_cum") >= F.floor((F.col("all") + 1) / 2), F.col("value")))
    upper = F.min(F.when(F.col("_cum") >= F.floor(F.col("all") / 2) + 1, F.col("value")))
    return ranked.agg(((lower + upper) / 2).alias(name))
