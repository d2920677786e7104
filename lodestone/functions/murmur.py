"""Rendezvous scores: standard 32-bit Murmur3, which Spark's own hash() is not."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def murmur3_32(data: bytes, seed: int = 0) -> int:
    mask = 0xFFFFFFFF

    def scramble(k: int) -> int:
        k = k * 0xCC9E2D51 & mask
        return ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask

    h, whole = seed, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h ^= scramble(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & mask
    if data[whole:]:
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def rendezvous_score(node: Column, key: Column, weight: Column | None = None) -> Column:
    """weight times -ln(hash(node then key) / (2 ** 32 - 1))."""

    @F.pandas_udf("double")
    def score(node: pd.Series, key: pd.Series) -> pd.Series:
        h = np.array([murmur3_32((a + b).encode()) for a, b in zip(node, key, strict=True)], float)
        with np.errstate(divide="ignore"):
            return pd.Series(-np.log(h / 0xFFFFFFFF))

    return score(node, key) * (weight if weight is not None else F.lit(1.0))
