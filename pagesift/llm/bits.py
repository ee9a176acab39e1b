"""Bloom filters of a bounded size over 64-bit hashes, built by Spark in slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.common import U64, mix

BITS_PER_ROW = 16
MIN_BITS, MAX_BITS = 1 << 16, 1 << 27  # 16 MB at most
HASHES = 3
SLICE_BITS = 1 << 16
PARTS = 32  # first step of merging: so many groups for each slice


def filter_bits(rows: int) -> int:
    """Bits for ``rows`` rows: a power of two, between fixed bounds."""
    return min(max(MIN_BITS, 1 << (max(rows, 1) * BITS_PER_ROW - 1).bit_length()), MAX_BITS)


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """``HASHES`` bit positions for each 64-bit hash, one column a hash."""
    h = h.view(U64)
    return np.stack([mix(h + U64(j * 0x9E3779B97F4A7C15 % 2**64)) & U64(bits - 1)
                     for j in range(HASHES)], axis=1).astype(np.int64)


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(bits, np.uint8)
        for batch in batches:
            h = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            if len(h):
                # A hash whose positions coincide counts once there.
                p = np.sort(positions(h, bits), axis=1)
                again = np.zeros(p.shape, bool)
                again[:, 1:] = p[:, 1:] == p[:, :-1]
                at, n = np.unique(p[~again], return_counts=True)
                counts[at] = np.minimum(counts[at] + np.minimum(n, 2), 2)
        for s in range(0, bits, SLICE_BITS):
            part = counts[s:s + SLICE_BITS]
            if part.any():
                packed = np.packbits(part >= 1).tobytes() + np.packbits(part >= 2).tobytes()
                yield pa.RecordBatch.from_pydict({"slice": pa.array([s // SLICE_BITS], pa.int32()),
                                                  "counts": pa.array([packed], pa.binary())})
    return run


def _merge(table: pa.Table) -> pa.Table:
    once = twice = np.zeros(SLICE_BITS // 8, np.uint8)
    for raw in table.column("counts"):
        both = np.frombuffer(raw.as_buffer(), np.uint8)
        o, t = both[:len(both) // 2], both[len(both) // 2:]
        twice = twice | t | (once & o)
        once = once | o
    return pa.table({"slice": table.column("slice")[:1],
                     "counts": pa.array([once.tobytes() + twice.tobytes()], pa.binary())})


def set_bits(hashes: DataFrame, bits: int, repeated: bool = False) -> np.ndarray:
    """Packed bits that the rows of ``hashes`` (one long) set; with
    ``repeated`` those that more than one row sets.  The driver gets bits / 8
    bytes, ``MAX_BITS`` / 8 at most."""
    schema = "slice int, counts binary"
    merged = (hashes.mapInArrow(_count(bits), schema)
              .withColumn("part", F.spark_partition_id() % PARTS)
              .groupBy("slice", "part")
              .applyInArrow(lambda key, t: _merge(t.select(["slice", "counts"])), schema)
              .groupBy("slice").applyInArrow(_merge, schema))
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        half = len(row.counts) // 2
        out[row.slice * half:(row.slice + 1) * half] = np.frombuffer(
            row.counts[half:] if repeated else row.counts[:half], np.uint8)
    return out


def has_bits(packed: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each hash: are all of its bits set?"""
    p = positions(h, len(packed) * 8)
    return (packed[p >> 3] >> (7 - (p & 7)) & 1).all(axis=1)


def longs(column: pa.Array) -> np.ndarray:
    """A column of longs; null counts as 0."""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def tester(spark: SparkSession, packed: np.ndarray):
    """``has_bits`` as a column function of a long."""
    shared = spark.sparkContext.broadcast(packed)

    @F.arrow_udf("boolean")  # without pandas, which each worker would keep 24 MB of
    def maybe(h: pa.Array) -> pa.Array:
        return pa.array(has_bits(shared.value, longs(h)), pa.bool_())
    return maybe
