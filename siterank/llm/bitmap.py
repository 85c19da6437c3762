"""A bitmap of hashed keys, of one fixed size: it lets through every key it was made of, and few others while the
keys are few. It thins out rows before an exact join; with very many keys it only thins out less."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 26  # 8 MB
BUCKET = 1 << 15  # bits that Spark's bitmap functions put into one value


def slot(*key: Column) -> Column:
    """A key's place, 1 to SLOTS."""
    return F.pmod(F.xxhash64(*key), F.lit(SLOTS)) + 1


def bitmap(slots: DataFrame, name: str) -> Broadcast:
    """The slots in a column, sent to all executors: SLOTS / 8 bytes whatever the number of rows."""
    parts = (
        slots.groupBy(F.bitmap_bucket_number(name).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(name)).alias("bits"))
        .collect()
    )
    out = np.zeros(SLOTS // 8, np.uint8)
    for part in parts:
        low = (part["bucket"] - 1) * (BUCKET // 8)
        out[low : low + BUCKET // 8] = np.frombuffer(part["bits"], np.uint8)
    return slots.sparkSession.sparkContext.broadcast(out)


def holds(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    at = slots - 1
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
