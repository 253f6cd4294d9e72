"""Bounded Bloom filters of 64-bit keys: Spark makes them, tasks probe them.

A filter never misses a key and may hold others, so it only saves work: what
passes is still joined exactly.  One bit of one 64-bit slot per key, ``SLOTS``
slots at most (8 MB), however many keys there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 20


def holds(slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter may hold the keys (uint64)."""
    word = slots[(keys >> np.uint64(6)) & np.uint64(len(slots) - 1)]
    return (word >> (keys & np.uint64(63))) & np.uint64(1) != 0


def make_filter(keys: DataFrame, column: str = "key") -> np.ndarray:
    """The filter of a column of keys (bigint); at most ``SLOTS`` short rows
    reach the driver."""
    n = keys.count()
    size = min(SLOTS, max(SLOTS // 8, 1 << (4 * n).bit_length()))
    rows = keys.select(F.shiftrightunsigned(column, 6).bitwiseAND(F.lit(size - 1)).cast("int").alias("slot"),
                       F.expr(f"shiftleft(1L, cast({column} & 63 AS int))").alias("bit"))
    found = rows.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    slots = np.zeros(size, dtype=np.int64)
    slots[found.column("slot").to_numpy()] = found.column("bits").to_numpy()
    return slots.view(np.uint64)
