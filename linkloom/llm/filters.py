"""Bloom filters made by tasks and asked in Python."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each hash, at least, and the logarithm of the most bits that a filter has (128 MB).
BITS_EACH, MOST_BITS = 16, 30


@dataclass
class Filter:
    """Three places for each 64-bit hash, in 64-bit cells; their number is a power of two."""

    cells: np.ndarray

    def __contains__(self, h: int) -> bool:
        at, step, mask = h & 0xFFFFFFFF, h >> 32 & 0xFFFFFFFF | 1, 64 * len(self.cells) - 1
        return all(int(self.cells[(at + i * step & mask) >> 6]) >> (at + i * step & 63) & 1 for i in range(3))

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Of unsigned hashes which are in it."""
        at, step, mask = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1), np.uint64(64 * len(self.cells) - 1)
        out = np.ones(len(h), bool)
        for i in range(3):
            p = at + np.uint64(i) * step & mask
            out &= (self.cells[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def filter_of(hashes: DataFrame, n: int) -> Filter:
    """The filter of the n hashes in column h, sized by n. Tasks set the bits of cells; the driver gets the cells."""
    size = min(MOST_BITS, max(6, (BITS_EACH * n - 1).bit_length()))
    step = F.shiftrightunsigned("h", 32).bitwiseOR(F.lit(1))
    places = F.array(*[(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)) + i * step).bitwiseAND(F.lit((1 << size) - 1)) for i in range(3)])
    set_bits = hashes.select(F.explode(places).alias("p")).select(F.shiftright("p", 6).alias("cell"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("bit"))
    got = set_bits.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    cells = np.zeros(1 << (size - 6), np.uint64)
    cells[got["cell"].to_numpy()] = got["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return Filter(cells)
