"""A filter of hashes as a bit field of bounded size, OR-ed together by Spark.

Used to drop rows that cannot match before a shuffle join on the hash; a
false hit only costs a row, the join is exact.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BITS = 26
_MIN_BITS = 16
_BITS_PER_HASH = 32


class BitFilter(NamedTuple):
    bits: int
    field: np.ndarray

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each 64-bit hash may be among those of the filter."""
        low = np.uint64((1 << self.bits) - 1)

        def bit(at: np.ndarray) -> np.ndarray:
            return (self.field[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1)

        return (bit(hashes & low) & bit((hashes >> np.uint64(32)) & low)).astype(bool)


def bit_filter(hashes: DataFrame, column: str = "hash", max_bits: int = MAX_BITS) -> BitFilter:
    """The filter of all values of a long column; two bits a value, and about
    ``_BITS_PER_HASH`` bits of room for each up to 2^``max_bits`` in all.  The
    driver gets at most one row for each 32 bits."""
    n = hashes.count()
    bits = min(max_bits, max(_MIN_BITS, (n * _BITS_PER_HASH).bit_length()))
    low = F.lit((1 << bits) - 1).cast("long")
    places = F.array(F.col(column).bitwiseAND(low), F.shiftrightunsigned(column, 32).bitwiseAND(low))
    value = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(31)).cast("int"))
    words = (hashes.select(F.explode(places).alias("bit"))
             .groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(value).alias("value")).toPandas())
    field = np.zeros((1 << bits) // 32, np.uint32)
    field[words["word"].to_numpy(np.int64)] = words["value"].to_numpy(np.int64).astype(np.uint32)
    return BitFilter(bits, field)
