"""Bitmaps of hashes: filters of a bounded size that may let others through."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the most bits a bitmap has (32 MB)
BITMAP_BITS = 28


def bitmap(hashes: DataFrame, name: str) -> np.ndarray:
    """A bit for the first bits of every hash, about 16 times as many bits as
    hashes and at most 2**BITMAP_BITS."""
    n = hashes.count()
    bits = min(max((16 * n - 1).bit_length() if n else 0, 12), BITMAP_BITS)
    words = hashes.select(F.shiftrightunsigned(name, 64 - bits).alias("b")) \
        .select(F.shiftright("b", 6).alias("word"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("b")) \
        .groupBy("word").agg(F.bit_or("b").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    bit = hashes >> np.uint64(64 - (6 + (len(bitmap) - 1).bit_length()))
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
