"""A bitmap of hashed values, of bounded size, that tasks use to skip what a later exact join would drop."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many bits (32 MB). A fuller bitmap passes more values than needed, never fewer.
MAX_BITS = 1 << 28
_CHUNK = 1 << 19


def build(marks: DataFrame) -> np.ndarray:
    """Bits of the low bits of `marks` (one long column of hashes), 16 bits a value up to MAX_BITS, built in chunks of 64 KB."""
    name = marks.columns[0]
    n = marks.count()
    size = _CHUNK
    while size < min(16 * n, MAX_BITS):
        size *= 2
    out = np.zeros(size // 8, np.uint8)
    distinct = marks.select(F.col(name).bitwiseAND(F.lit(size - 1)).alias("bit")).distinct()

    def chunk(t: pa.Table) -> pa.Table:
        at = np.asarray(t.column("bit"))
        bits = np.zeros(_CHUNK, bool)
        bits[at % _CHUNK] = True
        return pa.table({"chunk": pa.array([int(at[0]) // _CHUNK], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    for r in distinct.groupBy(F.floor(F.col("bit") / _CHUNK).alias("c")).applyInArrow(chunk, "chunk long, bits binary").toLocalIterator():
        out[r["chunk"] * _CHUNK // 8 : (r["chunk"] + 1) * _CHUNK // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def test(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes may be among the marks."""
    bit = values.view(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
