"""Bloom filters of a fixed size, built by slices of the hash range and sent to every executor.

A filter has ``bits`` bits whatever the input, so its size is bounded by a parameter. With more keys its error rate rises and more
rows pass; every user of a filter confirms what passes, so results never depend on it.

Each slice of the hash range is built by one task that streams packed hashes and sets bits; only the finished slices, whose
total size is fixed, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.arrow_text import mix

SLICES = 1024
PROBES = 4
PACKED = "slice int, known boolean, hashes binary"
_ONE = np.uint8(1)


def slice_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(54)).astype(np.int64)


def _inside(h: np.ndarray, width: int, probe: int) -> np.ndarray:
    """Bit number inside a slice of ``width`` bits."""
    return (h + np.uint64(probe) * ((h >> np.uint64(20)) | np.uint64(1))) % np.uint64(width)


def has(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter may hold. Later probes only look at what the earlier ones left."""
    at, width = np.arange(len(h)), len(table) * 8 // SLICES
    for i in range(PROBES):
        left = h[at]
        place = (left >> np.uint64(54)) * np.uint64(width) + _inside(left, width, i)
        at = at[(table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & _ONE).astype(bool)]
        if not len(at):
            break
    found = np.zeros(len(h), dtype=bool)
    found[at] = True
    return found


def pack(h: np.ndarray) -> list[tuple[int, bool, bytes]]:
    """Rows of ``PACKED`` for the hashes of one batch; a hash that comes up twice in it goes once, as known to repeat."""
    values, counts = np.unique(h, return_counts=True)
    rows: list[tuple[int, bool, bytes]] = []
    for known in (False, True):
        part = values[(counts > 1) == known]
        cut = np.searchsorted(slice_of(part), np.arange(SLICES + 1))
        rows += [(s, known, part[a:b].tobytes()) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    return rows


def packed_batch(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    s, k, h = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(s, pa.int32()), pa.array(k, pa.bool_()), pa.array(h, pa.binary())], names=["slice", "known", "hashes"])


def build(packed: DataFrame, once_bits: int, twice_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """What occurs at all and what occurs twice or more, as two filters of fixed size."""
    once_bytes, twice_bytes = once_bits // SLICES // 8, twice_bits // SLICES // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for s, known, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s not in tables:
                    tables[s] = (np.zeros(once_bytes, dtype=np.uint8), np.zeros(twice_bytes, dtype=np.uint8))
                once, twice = tables[s]
                h = np.frombuffer(data, dtype=np.uint64)
                again = h if known else h[_local(once, h)]
                _put_local(twice, again)
                _put_local(once, h)
        for s, (once, twice) in tables.items():
            yield pa.record_batch(
                [pa.array([s], pa.int32()), pa.array([once.tobytes()], pa.binary()), pa.array([twice.tobytes()], pa.binary())],
                names=["slice", "once", "twice"],
            )

    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = packed.repartition(parts, "slice").mapInArrow(run, "slice int, once binary, twice binary")
    once, twice = np.zeros(once_bytes * SLICES, dtype=np.uint8), np.zeros(twice_bytes * SLICES, dtype=np.uint8)
    # All slices together have a fixed size.
    for s, a, b in zip(*slices.toArrow().columns, strict=True):
        at = s.as_py()
        once[at * once_bytes : (at + 1) * once_bytes] = np.frombuffer(a.as_buffer(), dtype=np.uint8)
        twice[at * twice_bytes : (at + 1) * twice_bytes] = np.frombuffer(b.as_buffer(), dtype=np.uint8)
    return once, twice


def _local(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``has`` for the table of one slice."""
    found = np.ones(len(h), dtype=bool)
    for i in range(PROBES):
        place = _inside(h, len(table) * 8, i)
        found &= (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & _ONE).astype(bool)
    return found


def _put_local(table: np.ndarray, h: np.ndarray) -> None:
    for i in range(PROBES):
        place = _inside(h, len(table) * 8, i)
        np.bitwise_or.at(table, place >> np.uint64(3), _ONE << (place & np.uint64(7)).astype(np.uint8))


def ids_filter(ids: DataFrame, bits: int = 1 << 26) -> np.ndarray:
    """Filter of a one-column table of whole-number ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield packed_batch(pack(id_hash(batch.column(0))))

    return build(ids.select(F.col(ids.columns[0]).cast("long")).mapInArrow(run, PACKED), bits, SLICES * 64)[0]


def id_hash(column: pa.Array) -> np.ndarray:
    return mix(column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(1))
