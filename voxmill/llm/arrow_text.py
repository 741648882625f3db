"""Whole texts of an Arrow batch as numpy arrays: words, word hashes and rolling hashes.

Texts stay in the byte buffer that Spark hands over; nothing is built per word. All work goes over
pieces of a batch of at most ``PIECE`` bytes (or one longer text), so memory does not follow the batch.
A word is a run of bytes other than 0x20 and 0x09-0x0D; UTF-8 has these bytes for these characters only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import SparkSession

PIECE = 1 << 21
# A word longer than this is hashed on its own, so that the tables of powers stay small.
LONG_WORD = 1 << 16
_SPAN = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Gaps between words for matching that ignores punctuation: every ASCII byte but letters and digits.
NOT_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD_BASE = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.bases = (base, _inverse(base))
        self.tables = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tables[0]) < n:
            for i, base in enumerate(self.bases):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                self.tables[i] = np.cumprod(steps)
        return self.tables[0][:n], self.tables[1][:n]


_CHAR_POWERS = _Powers(_BASE)
_WORD_POWERS = tuple(_Powers(b) for b in _WORD_BASE)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a text column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offs is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Piece:
    """Rows ``first`` to ``last`` of a batch; word ``i`` is ``data[starts[i]:ends[i]]``, row ``r`` has the words
    ``bounds[r]`` to ``bounds[r + 1]``."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.bounds))


def pieces(
    column: pa.Array | pa.ChunkedArray, lower: bool = False, gaps: np.ndarray = SPACE, limit: int = PIECE
) -> Iterator[Piece]:
    data, offsets = buffers(column)
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        part = data[offsets[first] : offsets[last]]
        own = offsets[first : last + 1] - offsets[first]
        starts, ends = find_words(part, own, gaps)
        yield Piece(first, last, LOWER[part] if lower else part, own, starts, ends, np.searchsorted(starts, own))
        first = last


def find_words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    solid = ~gaps[data]
    head, tail = solid.copy(), solid.copy()
    head[1:] &= ~solid[:-1]
    tail[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    head[inner] = solid[inner]
    tail[inner - 1] = solid[inner - 1]
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def word_hashes(p: Piece) -> np.ndarray:
    """64-bit hash of every word; equal words have equal hashes in every piece."""
    n = len(p.starts)
    out = np.empty(n, dtype=np.uint64)
    lengths = p.ends - p.starts
    i = 0
    while i < n:
        if lengths[i] > LONG_WORD:
            out[i] = xxhash.xxh3_64_intdigest(p.data[p.starts[i] : p.ends[i]].tobytes())
            i += 1
            continue
        j = int(np.searchsorted(p.ends, p.starts[i] + _SPAN, side="right"))
        long = np.flatnonzero(lengths[i:j] > LONG_WORD)
        j = i + int(long[0]) if len(long) else max(j, i + 1)
        lo, hi = int(p.starts[i]), int(p.ends[j - 1])
        power, inverse = _CHAR_POWERS.upto(hi - lo + 1)
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTES[p.data[lo:hi]] * power[: hi - lo], out=total[1:])
        s, e = p.starts[i:j] - lo, p.ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * inverse[s] + lengths[i:j].astype(np.uint64)
        i = j
    return mix(out)


def rolling(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of ``words[i:i + size]`` for every i where that many words are left (across rows as well)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    words = mix(words ^ np.uint64(0x5851F42D4C957F2D * (which + 1) & (2**64 - 1)))
    out = np.empty(n, dtype=np.uint64)
    step = 1 << 18
    for lo in range(0, n, step):
        part = words[lo : min(lo + step, n) + size - 1]
        power, inverse = _WORD_POWERS[which].upto(step + size)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * power[: len(part)], out=total[1:])
        m = len(part) - size + 1
        out[lo : lo + m] = (total[size:] - total[:m]) * inverse[:m]
    return mix(out)


def whole_windows(bounds: np.ndarray, size: int, n_words: int) -> np.ndarray:
    """Which of the windows of ``rolling`` lie inside one row."""
    n = n_words - size + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    inside = np.ones(n, dtype=bool)
    # A window that starts in the last size - 1 words of a row reaches into the next one.
    ends = bounds[1:]
    for k in range(1, size):
        at = ends - k
        at = at[(at >= bounds[:-1]) & (at < n)]
        inside[at] = False
    return inside


BATCH_BYTES = "4m"
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at 4 MB, unless the session has a limit of its own: 10,000 long texts would be one batch otherwise."""
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)
