"""A filter of fixed size over a set of 64-bit keys, made by Spark and broadcast.

Each key sets two of ``2 ** bits`` bits (its top bits and those below).  Spark ORs them in
words of 64, so at most ``2 ** bits / 64`` rows reach the driver, whatever the number of
keys.  A key of the set always passes; others pass the more often the fuller the map is,
so an exact join must follow.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26  # 8 MB


def _places(key: Column, bits: int) -> Column:
    top = F.shiftrightunsigned(key, 64 - bits)
    return F.array(top, F.shiftrightunsigned(key, 64 - 2 * bits).bitwiseAND((1 << bits) - 1))


def bitmap(keys: DataFrame, key: str = "key", bits: int = BITS) -> np.ndarray:
    """The words of the map of all ``key`` values (longs)."""
    if not 6 < bits <= 32:
        raise ValueError("a map needs more than 64 bits and at most 2 ** 32")
    place = keys.select(F.explode(_places(F.col(key), bits)).alias("p"))
    word = place.groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("m")
    )
    got = word.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got.column("w").to_numpy()] = got.column("m").to_numpy()
    return out.view(np.uint64)


def passing(words: np.ndarray, keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Which keys (uint64) may be in the set."""
    top = keys >> np.uint64(64 - bits)
    ok = (words[top >> np.uint64(6)] >> (top & np.uint64(63))) & np.uint64(1) == 1
    at = np.flatnonzero(ok)
    low = (keys[at] >> np.uint64(64 - 2 * bits)) & np.uint64((1 << bits) - 1)
    ok[at] = (words[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) == 1
    return ok
