"""Bloom filters of bounded size, built in tasks and probed before rows move.

A filter is cut into segments; all bits of one value lie in one segment. So a segment is built by whoever gets its
values, and the driver only ever holds the finished filter, whose size has a fixed bound. Beyond the bound a filter
fills up: it then lets more values through, and never drops one that was put in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT_BITS = 1 << 19
MOST_SEGMENTS = 1 << 9  # 32 MB
BITS_FOR_EACH = 12
PROBES = 4
_U64 = np.uint64


def segments_for(n: int) -> int:
    """Number of segments of a filter of ``n`` values: a power of two up to ``MOST_SEGMENTS``."""
    wanted = -(-n * BITS_FOR_EACH // SEGMENT_BITS)
    return min(MOST_SEGMENTS, 1 << int(max(0, wanted - 1)).bit_length())


def _slots(hashes: np.ndarray) -> list[np.ndarray]:
    """Places of the bits of each value in its segment, from the low 58 bits of its hash."""
    step = (hashes >> _U64(20)) | _U64(1)
    return [((hashes + _U64(i) * step) & _U64(SEGMENT_BITS - 1)).astype(np.int64) for i in range(PROBES)]


def _segment(hashes: np.ndarray, n_segments: int) -> np.ndarray:
    return ((hashes >> _U64(50)) & _U64(n_segments - 1)).astype(np.int64)


def _segment_of(h: Column, n_segments: int) -> Column:
    return F.shiftrightunsigned(h, 50).bitwiseAND(F.lit(n_segments - 1))


def _fill(table: pa.Table) -> pa.Table:
    bits = np.zeros(SEGMENT_BITS, bool)
    for slot in _slots(table.column("h").to_numpy().view(_U64)):
        bits[slot] = True
    packed = np.packbits(bits, bitorder="little").tobytes()
    return pa.table({"segment": table.column("segment").slice(0, 1).cast(pa.int64()), "bits": pa.array([packed], pa.binary())})


def build(values: DataFrame, column: str, n: int) -> np.ndarray:
    """The filter (segments x bytes) of the 64-bit hashes in a column, made for ``n`` values; nulls are left out."""
    n_segments = segments_for(n)
    out = np.zeros((n_segments, SEGMENT_BITS // 8), np.uint8)
    for row in segments(values, column, n).collect():
        out[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return out


def segments(values: DataFrame, column: str, n: int) -> DataFrame:
    """The filter as a table (``segment``, ``bits``) of at most ``MOST_SEGMENTS`` rows, for ``probed``."""
    n_segments = segments_for(n)
    hashed = values.select(F.col(column).alias("h")).filter("h is not null")
    return hashed.withColumn("segment", _segment_of(F.col("h"), n_segments)).distinct().groupBy("segment").applyInArrow(_fill, "segment long, bits binary")


def probed(rows: DataFrame, h: Column, table: DataFrame, n: int) -> DataFrame:
    """The rows whose hash may be in the filter of ``segments``, found by a broadcast of it: no row moves, none goes to Python."""
    own = F.broadcast(table.select(F.col("segment").alias("_segment"), F.col("bits").alias("_bits")))
    joined = rows.withColumns({"_h": h, "_at": _segment_of(h, segments_for(n))}).join(own, F.col("_at") == F.col("_segment"))
    low = F.col("_h").bitwiseAND(F.lit(SEGMENT_BITS - 1))
    step = F.shiftrightunsigned("_h", 20).bitwiseOR(F.lit(1)).bitwiseAND(F.lit(SEGMENT_BITS - 1))
    found = F.lit(True)
    for i in range(PROBES):
        slot = (low + step * i).bitwiseAND(F.lit(SEGMENT_BITS - 1))
        byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(slot, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        found &= byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << b) for b in range(8))), (slot.bitwiseAND(F.lit(7)) + 1).cast("int"))) != 0
    return joined.filter(found).drop("_h", "_at", "_segment", "_bits")


def contains(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    hashes = hashes.astype(_U64, copy=False) if hashes.dtype != np.int64 else hashes.view(_U64)
    segment = _segment(hashes, len(table))
    out = np.ones(len(hashes), bool)
    for slot in _slots(hashes):
        out &= (table[segment, slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
    return out
