"""Substring dedup with fixed-block anchors: every word of a repeated run of ``window`` words goes.

1. Reference blocks: each text is cut into non-overlapping blocks of ``(window + 1) // 2`` words. Any window contains a whole block of
   its own text, wherever it starts. Two Bloom filters of fixed size index the blocks' hashes: those that occur, and those that
   occur twice or more.
2. Probes: every rolling block of every text is looked up, aligned ones in the second filter and all others in the first. If two
   equal windows exist, each of them holds a hit: the place where the other one has its reference block. So hits
   mark all windows that can be repeated, without any shuffle of probes.
3. Extension: the marked windows, and only these, are compared exactly by fingerprints of 96 bits that cover all their words.
   Overlapping equal windows join up to maximal exact repeats. A window seen twice in a batch is a repeat at once and goes on as one
   entry for all, so a passage that a third of all texts share costs one entry a batch. Windows are dealt by their
   smallest block hash, which neighbours share, so found repeats come back as runs.
4. The runs of each document are joined to it, and its covered words are cut.

The filters have a fixed size (``ONCE_BITS``, ``TWICE_BITS``); beyond some hundred million blocks they fill up and more windows are
marked. Then step 3 compares up to all windows, 16 bytes each, and the result stays the same.

Null and empty texts have no words and stay empty texts. All copies of a repeat go, the first included, also inside one text.
Rows that repeat a document lose everything a window covers. Rows are told apart by a 64-bit hash of id and text, so ids may
be of any type, null, or shared by different texts; each row is then a text of its own. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm import bloom
from voxmill.llm.arrow_text import Piece, bound_batches, mix, pieces, rolling, whole_windows, word_hashes
from voxmill.operators.scale import materialised

WINDOW = 35
ONCE_BITS = 1 << 28
TWICE_BITS = 1 << 26

_MARKED = "slice int, known boolean, high binary, low binary, ids binary, places binary"


def _aligned(p: Piece, block: int) -> np.ndarray:
    """Word numbers at which a reference block starts."""
    n = np.diff(p.bounds) // block
    row = np.repeat(np.arange(p.rows), n)
    return p.bounds[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * block


def _index(docs: DataFrame, block: int) -> DataFrame:
    """Packed hashes of the reference blocks of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.zeros(0, dtype=np.uint64)]
            for p in pieces(batch.column(0)):
                hashes = rolling(word_hashes(p), block)
                own.append(hashes[_aligned(p, block)] if len(hashes) else hashes)
            yield bloom.packed_batch(bloom.pack(np.concatenate(own)))

    return docs.select("_text").mapInArrow(run, bloom.PACKED)


def _sliding(values: np.ndarray, size: int, of: np.ufunc) -> np.ndarray:
    """``of`` over ``values[i:i + size]`` by doubling."""
    width, out = 1, values
    while width * 2 <= size:
        out = of(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return of(out[: len(out) - rest], out[rest:]) if rest else out


def _runs(ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Id, start and length of runs of neighbouring places; the places of an id come in order."""
    if not len(ids):
        return ids, places, places
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (places[1:] != places[:-1] + 1)
    at = np.flatnonzero(new)
    return ids[at], places[at], np.diff(np.append(at, len(ids))).astype(np.int32)


def _mark(p: Piece, ids: np.ndarray, window: int, once: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, ...]:
    """Marked windows of a piece: two halves of the fingerprint, dealing hash, id and word number inside the text."""
    block = (window + 1) // 2
    words = word_hashes(p)
    blocks = rolling(words, block)
    whole = whole_windows(p.bounds, block, len(words))
    aligned = np.zeros(len(blocks), dtype=bool)
    aligned[_aligned(p, block)] = True
    hit = np.zeros(len(blocks), dtype=bool)
    for at, table in ((whole & ~aligned, once), (aligned, twice)):
        place = np.flatnonzero(at)
        hit[place[bloom.has(table, blocks[place])]] = True
    fits = whole_windows(p.bounds, window, len(words))
    at = np.flatnonzero(fits & _sliding(hit, window - block + 1, np.logical_or)) if len(fits) else np.zeros(0, dtype=np.int64)
    if not len(at):
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint32, np.uint64, np.int64, np.int32))
    row = np.searchsorted(p.bounds, at, side="right") - 1
    deal = _sliding(blocks, window - block + 1, np.minimum)[at]
    low = (rolling(words, window, 1)[at] >> np.uint64(32)).astype(np.uint32)
    return rolling(words, window)[at], low, mix(deal), ids[row], (at - p.bounds[row]).astype(np.int32)


def _repeats(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every fingerprint and the size of its group."""
    order = np.lexsort((low, high))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    return group, np.bincount(group)


def _marked(docs: DataFrame, window: int, slices: int, once: np.ndarray, twice: np.ndarray) -> DataFrame:
    filters = docs.sparkSession.sparkContext.broadcast((once, twice))  # two tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            parts = [_mark(p, ids[p.first : p.last], window, *filters.value) for p in pieces(batch.column(1))]
            if not parts:
                continue
            high, low, deal, doc, place = (np.concatenate(c) for c in zip(*parts, strict=True))
            if not len(high):
                continue
            group, size = _repeats(high, low)
            several = size[group] > 1
            rows: list[tuple] = []
            if several.any():
                i, start, n = _runs(doc[several], place[several])
                rows.append((None, True, start.tobytes(), n.tobytes(), i.tobytes(), b""))
            first = np.zeros(len(high), dtype=bool)
            first[np.unique(group, return_index=True)[1]] = True
            part = ((deal >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
            for keep, known in ((~several, False), (several & first, True)):
                at = np.flatnonzero(keep)
                at = at[np.argsort(part[at], kind="stable")]
                cut = np.flatnonzero(np.diff(part[at], prepend=-1, append=slices + 1))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    x = at[a:b]
                    rest = (b"", b"") if known else (doc[x].tobytes(), place[x].tobytes())
                    rows.append((int(part[x[0]]), known, high[x].tobytes(), low[x].tobytes(), *rest))
            kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 4)
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=["slice", "known", "high", "low", "ids", "places"],
            )

    return docs.select("_key", "_text").mapInArrow(run, _MARKED)


_RUNS = "id long, start int, n int"


def _run_batch(ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(ids), pa.array(start), pa.array(n)], names=["id", "start", "n"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition of fingerprints: windows that a second text or batch has as well."""
    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
    if not rows:
        return
    join = lambda i, kind: np.frombuffer(b"".join(r[i] for r in rows), dtype=kind)
    sizes = [len(r[2]) // 4 for r in rows]
    known = np.repeat([r[0] for r in rows], sizes)
    group, size = _repeats(join(1, np.uint64), join(2, np.uint32))
    again = (size[group] > 1)[~known]
    yield _run_batch(*_runs(join(3, np.int64)[again], join(4, np.int32)[again]))


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, n, ids in zip(*(batch.column(c).to_pylist() for c in ("high", "low", "ids")), strict=True):
            yield _run_batch(np.frombuffer(ids, dtype=np.int64), np.frombuffer(start, dtype=np.int32), np.frombuffer(n, dtype=np.int32))


def repeated_runs(docs: DataFrame, window: int = WINDOW, once_bits: int = ONCE_BITS, twice_bits: int = TWICE_BITS) -> DataFrame:
    """``id, start, n`` from ``_key, _text``: n windows in a row, from word ``start`` on, occur somewhere else as well."""
    once, twice = bloom.build(_index(docs, (window + 1) // 2), once_bits, twice_bits)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = materialised(_marked(docs, window, 4 * parts, once, twice), "marked-windows")
    spread = marked.where(F.col("slice").isNotNull()).repartition(parts, "slice")
    return spread.mapInArrow(_confirmed, _RUNS).unionByName(marked.where(F.col("slice").isNull()).mapInArrow(_at_once, _RUNS))


def dedup_substrings(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    once_bits: int = ONCE_BITS, twice_bits: int = TWICE_BITS,
) -> DataFrame:
    """``docs`` with the kept words, joined by single spaces, as text, plus ``n_words`` and ``n_removed`` (in place of such columns)."""
    bound_batches(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed")
    keyed = docs.withColumn("__vx_id", F.xxhash64(id_col, text_col))
    runs = repeated_runs(keyed.select(F.col("__vx_id").alias("_key"), F.col(text_col).alias("_text")), window, once_bits, twice_bits)
    lists = runs.groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("__vx_runs")).withColumnRenamed("id", "__vx_id")
    # The lists are far smaller than the texts: hashing them saves sorting the texts.
    joined = keyed.join(lists.hint("shuffle_hash"), "__vx_id", "left").select(*docs.columns, "__vx_runs")
    at, names = docs.columns.index(text_col), [*docs.columns, "n_words", "n_removed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, removed = [], [], []
            for text, cut in zip(batch.column(at).cast(pa.binary()), batch.column("__vx_runs"), strict=True):
                words, n = (text.as_py() or b"").split(), 0
                total.append(len(words))
                if cut.is_valid:
                    edges = np.zeros(len(words) + 1, dtype=np.int32)
                    own = cut.values
                    start, length = own.field(0).to_numpy(), own.field(1).to_numpy()
                    # Of another row with the same hash, if ever; nothing outside of this text is cut.
                    inside = start + length + window - 1 <= len(words)
                    start, length = start[inside], length[inside]
                    np.add.at(edges, start, 1)
                    np.add.at(edges, start + length + window - 1, -1)
                    keep = np.cumsum(edges[:-1]) == 0
                    n = len(words) - int(keep.sum())
                    words = list(compress(words, keep))
                removed.append(n)
                texts.append(b" ".join(words).decode())
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.record_batch([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_words long, n_removed long"
    return joined.mapInArrow(run, schema)
