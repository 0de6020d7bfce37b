"""Bit filters of a fixed size over a column of 64-bit hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 26  # 8 MB; however many hashes go in, a filter only lets too much through


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    i = h & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[(i >> np.uint64(6)).astype(np.int64)] >> (i & np.uint64(63))) & np.uint64(1) == 1


def bit_filter(df: DataFrame, hashed: Column):
    """Broadcast words of the filter; only they reach the driver, whatever the table's size."""
    i = F.pmod(hashed, F.lit(1 << FILTER_BITS))
    words = (df.select(F.shiftright(i, 6).alias("w"), F.expr("1L").alias("one"), (i % 64).cast("int").alias("s"))
             .groupBy("w").agg(F.bit_or(F.expr("shiftleft(one, s)")).alias("bits")).toArrow())
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return df.sparkSession.sparkContext.broadcast(out)
