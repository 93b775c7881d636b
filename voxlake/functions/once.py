"""Compute expensive columns once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """`withColumns` whose expressions are evaluated once, however often later steps use them.

    Catalyst folds projections into each other and copies an array expression to every place that uses it. A
    one-element explode is a step it keeps, and stays inside whole-stage code.
    """
    kept = [c for c in df.columns if c not in columns]
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*kept, packed.alias("_once")).select(*kept, *[F.col(f"_once.{n}").alias(n) for n in columns])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, inside one expression."""
    return F.get(F.transform(F.array(value), body), 0)
