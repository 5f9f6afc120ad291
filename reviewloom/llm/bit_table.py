"""A table of bits that tells which 64-bit numbers belong to a set: it may say yes too often, never no.

It has about sixteen bits for each number and never more than ``most_bytes``, so
that it can be broadcast whatever the size of the set; a set too large for
it only passes more numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 16 << 20
BLOCK_BITS = 1 << 19


def told(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which unsigned ``numbers`` may belong to the set."""
    mask = np.uint64(8 * len(table) - 1)
    bit = lambda p: (table[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
    return (bit(numbers & mask) & bit((numbers >> np.uint64(32)) & mask)).astype(bool)


def bit_table(numbers: DataFrame, most_bytes: int = MOST_BYTES) -> np.ndarray:
    """Table of the long column of ``numbers``; set in tasks, block by block, and put together on the driver."""
    column, n, bits = numbers.columns[0], numbers.count(), BLOCK_BITS
    while bits < 8 * most_bytes and bits < 16 * n:
        bits *= 2

    def blocks(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            place = batch.column("place").to_numpy()
            for block in np.unique(place // BLOCK_BITS).tolist():
                held.setdefault(block, np.zeros(BLOCK_BITS, bool))[place[place // BLOCK_BITS == block] % BLOCK_BITS] = True
        for block, table in held.items():
            packed = np.packbits(table, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([packed], pa.binary())], ["block", "bits"])

    low = F.col(column).bitwiseAND(F.lit(bits - 1))
    high = F.shiftrightunsigned(column, 32).bitwiseAND(F.lit(bits - 1))
    places = numbers.select(F.explode(F.array(low, high)).alias("place"))
    dealt = places.repartition(bits // BLOCK_BITS, F.floor(F.col("place") / BLOCK_BITS))
    out = np.zeros((bits // BLOCK_BITS, BLOCK_BITS // 8), np.uint8)
    for row in dealt.mapInArrow(blocks, "block long, bits binary").collect():
        out[row["block"]] |= np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)
