"""A bitmap of fixed size that says which hashes may be in a column.

It is read before rows move: what it passes is checked by a join afterwards, so a fuller one costs traffic, never rows. Its
8 MB don't grow with the data.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26


def bitmap_of(keys: DataFrame, name: str) -> Broadcast:
    """The bitmap of a long column that holds hashes; its words are put together before they reach the driver."""
    bit = f"({name} & {(1 << BITS) - 1})"
    words = keys.groupBy(F.expr(f"cast(shiftright({bit}, 5) as int)").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast({bit} & 31 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITS - 5), dtype="uint32")
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype("uint32")
    return keys.sparkSession.sparkContext.broadcast(bitmap)


def passes(bitmap: Broadcast, hashes: np.ndarray) -> np.ndarray:
    low = (hashes.view("uint64") & np.uint64((1 << BITS) - 1)).astype("int64")
    return (bitmap.value[low >> 5] >> (low & 31).astype("uint32") & np.uint32(1)).astype(bool)
