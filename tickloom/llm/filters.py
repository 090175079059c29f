"""A filter of fixed size over 64-bit keys: what reaches the driver never grows with the data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

BITS = 1 << 24  # 2 MB


def key_filter(keys: DataFrame, name: str) -> np.ndarray:
    """One bit for each value of the long column; keys that aren't in the table may pass, none is missed."""
    bit = f"pmod(`{name}`, {BITS})"
    cells = keys.groupBy(F.expr(f"cast({bit} div 64 AS int)").alias("cell")).agg(F.expr(f"bit_or(shiftleft(1L, cast({bit} % 64 AS int)))").alias("bits"))
    out, rows = np.zeros(BITS // 64, np.int64), cells.toPandas()
    out[rows["cell"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def passes(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (int64 or uint64) may be in the filter."""
    bit = keys.view(np.uint64) & np.uint64(BITS - 1)
    return (held[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
