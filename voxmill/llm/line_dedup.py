"""Line dedup: two Bloom filters find suspected repeats; only those are counted exactly.

1. One scan turns every whole text into the fingerprints of its line keys (128 bits each, once per document). Keys held
   by two documents of the same Arrow batch are known repeats at once: their rows skip the filters, and one entry
   stands for all of them, so a line that half of all documents share costs one entry a batch.
2. The other fingerprints go to the filter of their hash range. Each partition builds a Bloom filter of what it has seen
   once and one of what it has seen twice, sized by its own rows; what the second one holds is a suspect. No
   filter leaves its partition and nothing is broadcast, so filters grow with the input and keep their error rate.
3. Suspects alone are grouped by their full fingerprint: exact document counts and the largest id (combined before the
   shuffle). Keys in at least ``min_docs`` documents lose their lines everywhere else.
4. Each document gets the keys it loses and is cut once.

Exact to fingerprints of 128 bits: two different lines share one with a chance of under 1e-14 among 10^12 lines.

A null or empty text is one empty line. Every row counts as a document of its own: rows that repeat a doc_id each
count, and all rows that hold the largest doc_id keep their lines. A null doc_id sorts below all others. Lines
shorter than ``min_chars`` always stay. Other columns pass through ``dedup_lines`` untouched; a null text comes back as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.arrow_text import bound_batches
from voxmill.operators.scale import materialised

MIN_CHARS = 40
MIN_DOCS = 5
_BLANK = " \t\n\x0b\x0c\r"
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_LOWEST = -(2**63)


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """Fingerprint of a line that is long enough to count, else None."""
    key = line.strip(_BLANK)
    return xxhash.xxh3_128_digest(key.translate(_LOWER).encode()) if len(key) >= min_chars else None


class BloomPair:
    """What was seen once and what was seen twice; ``add`` takes the two halves of the fingerprints."""

    def __init__(self, expected: int, bits_per_key: int = 16, probes: int = 4) -> None:
        self.bits = np.uint64(max(1024, expected * bits_per_key))
        self.once = np.zeros(int(self.bits) // 8 + 1, dtype=np.uint8)
        self.twice = np.zeros_like(self.once)
        self.probes = probes

    def _places(self, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        b = b | np.uint64(1)
        for i in range(self.probes):
            yield (a + np.uint64(i) * b) % self.bits

    def _has(self, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.ones(len(a), dtype=bool)
        for at in self._places(a, b):
            found &= (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
        return found

    def _put(self, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        for at in self._places(a, b):
            np.bitwise_or.at(table, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def add(self, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> None:
        """Insert rows that are all different among themselves; ``known`` ones count as seen twice."""
        again = self._has(self.once, a, b) | known
        self._put(self.twice, a[again], b[again])
        self._put(self.once, a, b)

    def seen_twice(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._has(self.twice, a, b)


_LINES = "bucket int, known boolean, keys binary, ids binary"


def _line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int, ranges: int) -> DataFrame:
    """Packed rows: the keys and ids of one batch in one hash range. Known repeats have no range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {line_key(x, min_chars) for x in (text.as_py() or "").split("\n")}
                own.discard(None)
                keys.extend(own)
                ids.extend([_LOWEST if doc is None else doc] * len(own))
            if not keys:
                continue
            key = np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)
            doc = np.array(ids, dtype=np.int64)
            order = np.lexsort((key[:, 1], key[:, 0]))
            key, doc = key[order], doc[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]).any(axis=1)
            group = np.cumsum(new) - 1
            several = np.bincount(group)[group] > 1
            rows: list[tuple] = []
            if several.any():
                rows.append((None, True, key[several].tobytes(), doc[several].tobytes()))
            for mask, known in ((~several, False), (new & several, True)):
                k, d = key[mask], doc[mask]
                bucket = ((k[:, 0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(int)
                for b in np.unique(bucket):
                    at = bucket == b
                    rows.append((int(b), known, k[at].tobytes(), b"" if known else d[at].tobytes()))
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.binary(), pa.binary()), strict=True)],
                names=["bucket", "known", "keys", "ids"],
            )

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, _LINES)


def _unpacked(keys: bytes, ids: bytes) -> pa.RecordBatch:
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys) // 16, [None, pa.py_buffer(keys)])
    return pa.record_batch([raw.cast(pa.binary()), pa.array(np.frombuffer(ids, dtype=np.int64))], names=["key", "id"])


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition of hash ranges: build the two filters, then pass on what the second one holds."""
    packs = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
    filters = BloomPair(sum(len(keys) for _, keys, _ in packs) // 16)
    for known, keys, _ in packs:
        k = np.frombuffer(keys, dtype=np.uint64).reshape(-1, 2)
        filters.add(k[:, 0], k[:, 1], np.full(len(k), known))
    for known, keys, ids in packs:
        if known:
            continue
        k = np.frombuffer(keys, dtype=np.uint64).reshape(-1, 2)
        at = filters.seen_twice(k[:, 0], k[:, 1])
        if at.any():
            yield _unpacked(k[at].tobytes(), np.frombuffer(ids, dtype=np.int64)[at].tobytes())


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, ids in zip(batch.column("keys").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            yield _unpacked(keys, ids)


def lost_keys(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``id, lost``: for each document that loses lines, the fingerprints of their keys."""
    # The filters of a partition are as large as its share of the keys, so their number follows the session's partitions.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = materialised(_line_keys(docs, id_col, text_col, min_chars, 4 * parts), "line-keys")
    ranged = packed.where(F.col("bucket").isNotNull()).repartition(parts, "bucket")
    suspects = ranged.mapInArrow(_suspects, "key binary, id long").unionByName(
        packed.where(F.col("bucket").isNull()).mapInArrow(_known, "key binary, id long")
    )
    suspects = materialised(suspects, "suspected-lines")
    repeated = suspects.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
    # Written, so that both sides of the join are plain scans and Spark can split the partition of a very common line.
    repeated = materialised(repeated.where(F.col("n") >= min_docs).select("key", "keeper"), "repeated-lines")
    return (
        suspects.join(repeated, "key")
        .where(F.col("id") < F.col("keeper"))
        .groupBy("id")
        .agg(F.array_sort(F.collect_set("key")).alias("lost"))
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    counts: bool = True,
) -> DataFrame:
    """``docs`` with the kept lines as text; with ``counts`` also ``n_lines`` and ``n_dropped``, in place of columns of that name."""
    bound_batches(docs.sparkSession)
    added = ["n_lines", "n_dropped"] if counts else []
    docs = docs.drop(*added)
    lost = lost_keys(docs, id_col, text_col, min_chars, min_docs).withColumnsRenamed({"id": "__vx_id", "lost": "__vx_lost"})
    # The lists of keys are far smaller than the texts: hashing them saves sorting the texts.
    keyed = docs.withColumn("__vx_id", F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)))
    joined = keyed.join(lost.hint("shuffle_hash"), "__vx_id", "left").select(*docs.columns, "__vx_lost")
    at, names = docs.columns.index(text_col), [*docs.columns, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, dropped = [], [], []
            for text, gone in zip(batch.column(at), batch.column(len(names) - len(added)).to_pylist(), strict=True):
                text = text.as_py() or ""
                n, cut = text.count("\n") + 1, 0
                if gone:
                    gone = set(gone)
                    kept = [x for x in text.split("\n") if line_key(x, min_chars) not in gone]
                    text, cut = "\n".join(kept), n - len(kept)
                texts.append(text)
                total.append(n)
                dropped.append(cut)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            columns += [pa.array(total, pa.int64()), pa.array(dropped, pa.int64())] if counts else []
            yield pa.record_batch(columns, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(run, schema + "".join(f", {c} long" for c in added))
