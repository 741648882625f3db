"""Pattern tables of any size: where their strings occur inside texts, without moving texts and without a copy of the table in every task.

1. Every pattern has a seed, its first bytes: as many as the largest power of two that is no longer than the pattern. Seeds and whole patterns
   are hashed, and two filters of a fixed number of bits are made of them, by slices of the hash range.
2. A scan takes the rolling hash of every window of a seed's length. Where the first filter knows it, the hash of each length that patterns
   with such seeds have is probed in the second one. Cost follows the text, not the table.
3. What passes is joined to the patterns by hash and compared byte by byte. Hot patterns are cut into pieces by their count.

Filters only save work: when a table fills them up, more is joined, and the results stay the same. UTF-8 keeps byte matches and
character matches the same. Null and empty patterns are left out, equal ones count once; null texts hold nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.operators.scale import materialised, salted_join

FILTER_BITS = 1 << 26
# A filter grows with its table, up to a size that every task can hold.
KEY_BITS = 32
MOST_FILTER_BITS = 1 << 30
PROBES = 3
_SLICES = 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


# ---------------------------------------------------------------- hashes
def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64))


class Rolling:
    """Hashes of any stretches of one byte string."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        power, self.inverse = np.full(n, _BASE), np.full(n + 1, _INVERSE)
        power[:1], self.inverse[0] = 1, 1
        self.inverse = np.cumprod(self.inverse)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * np.cumprod(power), out=self.sums[1:])

    def of(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        sizes = np.asarray(sizes, dtype=np.int64)
        return _mixed((self.sums[starts + sizes] - self.sums[starts]) * self.inverse[starts] + sizes.astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all stretches of one size, in order."""
        n = max(len(self.sums) - size, 0)
        return _mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n] + np.uint64(size))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column without nulls."""
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    if not len(wide):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def hash_texts(column: pa.Array) -> np.ndarray:
    """Hash of every string."""
    data, offsets = bytes_of(column)
    return Rolling(data).of(offsets[:-1], np.diff(offsets))


# ---------------------------------------------------------------- filters
def _place(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    at = h + np.uint64(probe) * ((h >> np.uint64(17)) | np.uint64(1))
    return at % np.uint64(bits) if bits & (bits - 1) else at & np.uint64(bits - 1)


def known_at(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Indices of the hashes the filter may hold. Later probes are made for those only that passed the ones before."""
    width = len(table) * 8 // _SLICES
    left = None
    for i in range(PROBES):
        own = h if left is None else h[left]
        at = (own >> np.uint64(56)) * np.uint64(width) + _place(own, i, width)
        passed = np.flatnonzero(table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1))
        left = passed if left is None else left[passed]
    return left


def known(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter may hold."""
    found = np.zeros(len(h), dtype=bool)
    found[known_at(table, h)] = True
    return found


def filter_bits(keys: int) -> int:
    """Bits of a filter of so many keys: few wrong answers as long as the most bits allow it."""
    return min(max(FILTER_BITS, 1 << (keys * KEY_BITS - 1).bit_length()), MOST_FILTER_BITS) if keys else FILTER_BITS


def hash_filter(hashes: DataFrame, bits: int | None = None) -> np.ndarray:
    """A filter of the one column of longs. Slices are made by tasks; all of them together have ``bits`` bits, by default as their number needs."""
    bits = bits or filter_bits(hashes.count())
    width = bits // _SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for s in np.unique(h >> np.uint64(56)).tolist():
                table = tables.setdefault(s, np.zeros(width // 8, dtype=np.uint8))
                own = h[h >> np.uint64(56) == s]
                for i in range(PROBES):
                    at = _place(own, i, width)
                    np.bitwise_or.at(table, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.record_batch([pa.array(list(tables), pa.int32()), pa.array([t.tobytes() for t in tables.values()], pa.binary())], names=["slice", "bits"])

    one = F.col(hashes.columns[0])
    made = hashes.select(one.alias("h")).repartition(F.shiftrightunsigned("h", 56)).mapInArrow(run, "slice int, bits binary")
    out = np.zeros((_SLICES, width // 8), dtype=np.uint8)
    for row in made.collect():  # _SLICES rows, ``bits`` bits
        out[row["slice"]] |= np.frombuffer(row["bits"], dtype=np.uint8)
    return out.reshape(-1)


# ---------------------------------------------------------------- pattern tables
def _seed_size(size: np.ndarray) -> np.ndarray:
    return 1 << np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)


@dataclass
class Probe:
    """What tasks need of a pattern table. There are fewer lengths than the square root of twice all patterns' bytes."""

    seeds: Broadcast[np.ndarray]
    wholes: Broadcast[np.ndarray]
    lengths: list[int]


@dataclass
class Patterns:
    """``table``: ``pattern, hash``, one row for each."""

    table: DataFrame
    probe: Probe


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batch, whose first column is the pattern, with its hashes and size."""
    for batch in batches:
        data, offsets = bytes_of(batch.column(0))
        sizes = np.diff(offsets)
        rolling = Rolling(data)
        whole, seed = rolling.of(offsets[:-1], sizes), rolling.of(offsets[:-1], np.minimum(_seed_size(sizes), sizes))
        more = [pa.array(whole.view(np.int64)), pa.array(seed.view(np.int64)), pa.array(sizes)]
        yield pa.record_batch([*batch.columns, *more], names=[*batch.schema.names, "hash", "seed", "size"])


def hashed_rows(rows: DataFrame) -> DataFrame:
    """``rows``, whose first column is a text and never null, with its ``hash``, ``seed`` and ``size`` (in bytes)."""
    own = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(_hashed, f"{own}, hash long, seed long, size long")


def hashed_patterns(patterns: DataFrame, column: str) -> DataFrame:
    """``pattern, hash, seed, size`` (in bytes) of the different patterns."""
    return hashed_rows(patterns.select(F.col(column).cast("string").alias("pattern")).where(F.col("pattern") != "").distinct())


def probe_of(table: DataFrame, bits: int | None = None) -> Probe:
    """The filters and lengths of a written table with ``hash, seed, size``."""
    lengths = sorted(r["size"] for r in table.select("size").distinct().collect())
    send = table.sparkSession.sparkContext.broadcast
    return Probe(send(hash_filter(table.select("seed"), bits)), send(hash_filter(table.select("hash"), bits)), lengths)


def prepare(patterns: DataFrame, column: str = "pattern", bits: int | None = None) -> Patterns:
    table = materialised(hashed_patterns(patterns, column), "patterns")
    return Patterns(table.select("pattern", "hash"), probe_of(table, bits))


def candidates(data: np.ndarray, offsets: np.ndarray, probe: Probe) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """``starts, size, hashes`` of the stretches inside one row that may be a pattern, for one size after the other."""
    rolling, lengths = Rolling(data), np.array(probe.lengths, dtype=np.int64)
    end_of = np.repeat(offsets[1:], np.diff(offsets))
    seeds, wholes = probe.seeds.value, probe.wholes.value
    for seed in np.unique(_seed_size(lengths)).tolist() if len(lengths) else []:
        starts = known_at(seeds, rolling.windows(seed))
        starts = starts[starts + seed <= end_of[starts]]
        for size in lengths[_seed_size(lengths) == seed].tolist():
            inside = starts[starts + size <= end_of[starts]]
            h = rolling.of(inside, size)
            at = known_at(wholes, h)
            if len(at):
                yield inside[at], size, h[at]


# Texts of a batch are searched in pieces of about this many bytes, or one longer text.
PIECE = 1 << 20


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int]]:
    offsets = bytes_of(batch.column(column))[1]
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1)
        yield first, last
        first = last


def _searcher(probe: Probe, once: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in pieces(batch, 1):
                part = batch.slice(first, last - first)
                data, offsets = bytes_of(part.column(1))
                row_of = np.repeat(np.arange(len(part)), np.diff(offsets))
                # Characters begin at bytes that continue none.
                begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                rows, hashes, at, found = [], [], [], []
                for starts, size, h in candidates(data, offsets, probe):
                    row = row_of[starts]
                    if once:
                        keep = np.unique(np.stack([row.astype(np.uint64), h]), axis=1, return_index=True)[1]
                        starts, row, h = starts[keep], row[keep], h[keep]
                    rows.append(row)
                    hashes.append(h)
                    at.append(begins[starts] - begins[offsets[row]])
                    found += [data[s : s + size].tobytes() for s in starts.tolist()]
                rows = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(rows)), pa.array(np.concatenate(hashes).view(np.int64) if hashes else [], pa.int64()),
                        pa.array(np.concatenate(at) if at else [], pa.int64()), pa.array(found, pa.binary()),
                    ], names=["row", "hash", "at", "found"],
                )

    return run


def occurrences(df: DataFrame, text: str, patterns: Patterns, once: bool = False) -> DataFrame:
    """``row, at, pattern``: where patterns occur, overlapping ones included; ``at`` counts characters from 0. ``row`` numbers the rows of ``df``.

    With ``once`` a pattern is reported once for each row that holds it.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = materialised(rows.mapInArrow(_searcher(patterns.probe, once), "row long, hash long, at long, found binary"), "candidates")
    joined = salted_join(found, patterns.table, "hash", "row", "inner")
    return joined.where(F.col("found") == F.col("pattern").cast("binary")).select("row", "at", "pattern")


# Counts of so many different strings are held by a task before it passes them on.
HELD = 1 << 18


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    same = np.ones(len(a), dtype=bool)
    for i in range(size):
        same &= data[a + i] == data[b + i]
    return same


def _row_counter(probe: Probe) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def counted(part: pa.RecordBatch, rows: Counter[bytes]) -> None:
        data, offsets = bytes_of(part.column(0))
        row_of = np.repeat(np.arange(len(part)), np.diff(offsets))
        for starts, size, h in candidates(data, offsets, probe):
            order = np.lexsort((row_of[starts], h))
            starts, h = starts[order], h[order]
            row = row_of[starts]
            fresh = np.append(True, h[1:] != h[:-1])
            group = np.cumsum(fresh) - 1
            first = starts[fresh]
            same = _same_bytes(data, starts, first[group], size)
            own, in_row = group[same], row[same]
            once = np.append(True, (own[1:] != own[:-1]) | (in_row[1:] != in_row[:-1]))
            for s, n in zip(first.tolist(), np.bincount(own[once], minlength=len(first)).tolist(), strict=True):
                rows[data[s : s + size].tobytes()] += n
            # Other strings with the same hash.
            rows.update(found for _, found in {(r, data[s : s + size].tobytes()) for r, s in zip(row[~same].tolist(), starts[~same].tolist(), strict=True)})

    def held(rows: Counter[bytes]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(rows), pa.binary()), pa.array(list(rows.values()), pa.int64())], names=["found", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: Counter[bytes] = Counter()
        for batch in batches:
            for first, last in pieces(batch, 0):
                counted(batch.slice(first, last - first), rows)
                if len(rows) > HELD:
                    yield held(rows)
                    rows = Counter()
        yield held(rows)

    return run


def rows_holding(df: DataFrame, text: str, patterns: Patterns) -> DataFrame:
    """``pattern, rows``: in how many rows each pattern occurs that occurs at all. Tasks count what they find, so no row is joined."""
    texts = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = texts.mapInArrow(_row_counter(patterns.probe), "found binary, rows long")
    counts = found.groupBy("found").agg(F.sum("rows").alias("rows"))
    return counts.join(patterns.table, F.col("found") == F.col("pattern").cast("binary")).select("pattern", "rows")
