"""Bitmaps of hashes, broadcast so that a scan passes on only rows that may meet others.

A bitmap never loses a row: what it passes wrongly, one key in 32 to 64, costs a shuffle, and a join decides.  It has
32 to 64 bits a key, between 2^20 bits and LARGEST, 32 MB; beyond some 10^7 keys it fills up and passes
more, until at the end every row is shuffled once, as without it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
LEAST, LARGEST = 20, 28


def bits_for(keys: int) -> int:
    """log2 of the bits for so many keys."""
    return min(max((32 * keys).bit_length(), LEAST), LARGEST)


class Marks:
    """A bitmap by the leading bits of 64-bit hashes."""

    def __init__(self, bits: int):
        self.bits = bits
        self.words = np.zeros(1 << (bits - 6), U)

    @classmethod
    def of(cls, df: DataFrame, column: str, bits: int | None = None) -> Marks:
        """Bits set by a long column of a table; a row for each 64 bits at most comes to the driver."""
        out = cls(bits or bits_for(df.count()))
        place = f"shiftrightunsigned({column}, {64 - out.bits})"
        got = df.groupBy(F.expr(f"shiftrightunsigned({place}, 6)").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({place} & 63 as int)))").alias("b")).toArrow()
        out.words[np.array(got.column("w"), np.int64)] = np.array(got.column("b"), np.int64).view(U)
        return out

    def marked(self, h: np.ndarray) -> np.ndarray:
        """Which hashes have their bit set."""
        at = h >> U(64 - self.bits)
        return (self.words[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) != 0
