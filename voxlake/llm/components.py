"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions.graph import connected_components, merged_components


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """`(node, component)` for every node of the links `(a, b)`; the component is the smallest node reachable. Without links
    there are no nodes. With `known` components, the links come on top of those that led to them."""
    ends = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return connected_components(ends) if known is None else merged_components(known, ends)
