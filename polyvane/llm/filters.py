"""A bit table over 64-bit hashes: what a broadcast may hold of a set that grows with the corpus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyvane.llm.textvec import U


class BitFilter:
    """Two bits a hash, from its highest and lowest bits, in a table of 64 bits a hash, at most 2 ** ``most`` bits (16 MB) however many there are.

    It lets through all members and, the fuller it is, others too; an exact join or count always follows. The table is put together by the
    executors: no more words come to the driver than it has.
    """

    def __init__(self, hashes: DataFrame, name: str, count: int, most: int = 27):
        self.bits = min(most, max(16, int(64 * count).bit_length()))
        high, low = F.shiftrightunsigned(name, 64 - self.bits), F.col(name).bitwiseAND((1 << self.bits) - 1)
        both = hashes.select(F.explode(F.array(high, low)).alias("x"))
        bit = F.expr("shiftleft(1L, cast(x & 63 as int))")
        table = both.select(F.shiftright("x", 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)
        self.words[table["w"].to_numpy()] = table["b"].to_numpy().view(np.uint64)

    def _has(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> U(6)] >> (place & U(63))) & U(1) == 1

    def __call__(self, value: np.ndarray) -> np.ndarray:
        """Whether each value may be a member."""
        out = self._has(value >> U(64 - self.bits))
        some = np.flatnonzero(out)
        out[some] = self._has(value[some] & U((1 << self.bits) - 1))
        return out
