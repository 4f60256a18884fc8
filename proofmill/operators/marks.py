"""A bitmap of bounded size that tells which 64-bit numbers can't be in a set, to leave out what a join would drop."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each number, up to MOST (16 MB) whatever their count: a fuller bitmap lets more through and loses nothing.
MARKS, MOST = 32, 1 << 27


def bitmap(numbers: DataFrame, column: str) -> np.ndarray:
    """Bits that are set for the numbers of a column: put together in words of 32 before they come to the driver."""
    n = numbers.count()
    size = 1 << 10
    while size < min(MOST, MARKS * n):
        size *= 2
    at = F.explode(F.array(F.col(column).bitwiseAND(size - 1), F.shiftrightunsigned(column, 32).bitwiseAND(size - 1))).alias("at")
    marks = numbers.select(at).groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits")).toArrow()
    bits = np.zeros(size // 32, "<u4")
    bits[marks.column("word").to_numpy()] = marks.column("bits").to_numpy().astype(np.uint32)
    return bits.view(np.uint8)


def marked(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which numbers (unsigned) may be in the bitmap."""
    size = np.uint64(len(bits) * 8 - 1)
    found = np.ones(len(numbers), bool)
    for at in (numbers & size, (numbers >> np.uint64(32)) & size):
        found &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return found
