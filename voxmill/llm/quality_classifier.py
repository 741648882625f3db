"""Quality classifier: a generalised additive model with pairwise interactions.

The score of a text is a sum of table look-ups: one table per feature over its bins and one per chosen pair of
features. The tables are learned by cyclic boosting: round after round every feature in turn gets one shallow
tree on the gradient of the log loss, shrunk and added to its table; the strongest pairs follow the same way.

Fitting uses at most ``MAX_LABELLED`` labelled rows (those with the smallest hash of the id, so the choice is
the same in every run), which is the only bounded sample here. Scoring goes once over every whole text.

Null and empty texts get the score of a text without words. A label that is null or neither 0 nor 1 is ignored; a
document labelled twice counts with its lowest label. Without labels, or with one class only, all scores are the
smoothed share of label 1. Repeated rows of a document are scored one by one. Columns besides the id and the text
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.arrow_text import Piece, bound_batches, pieces, word_hashes

MAX_LABELLED = 20_000

FEATURES = (
    "log_words", "word_bytes", "upper", "digits", "symbols", "bangs", "bars", "stops", "other_ascii", "non_ascii",
    "distinct_words", "repeated_neighbours", "line_words", "short_words", "long_words", "words_with_symbol",
)

_UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _BAR, _STOP, _OTHER, _SPACE, _LINE, _HIGH, _TAIL = range(12)
_CLASS = np.full(256, _OTHER, dtype=np.int64)
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[[ord(c) for c in "#$%&*<>@^~=+{}[]\\_"]] = _SYMBOL
_CLASS[ord("!")], _CLASS[ord("|")], _CLASS[ord("\n")] = _BANG, _BAR, _LINE
_CLASS[[ord(c) for c in ".,;:?"]] = _STOP
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = _SPACE
_CLASS[0xC0:] = _HIGH
_CLASS[0x80:0xC0] = _TAIL


def _features(p: Piece) -> np.ndarray:
    rows, n = p.rows, np.diff(p.bounds)
    row = np.repeat(np.arange(rows), np.diff(p.offsets))
    count = np.bincount(row * 12 + _CLASS[p.data], minlength=rows * 12).reshape(rows, 12).astype(float)
    chars = np.maximum(count[:, :_SPACE].sum(axis=1) + count[:, _HIGH], 1)
    letters = np.maximum(count[:, _UPPER] + count[:, _LOWER], 1)
    of = p.row_of_word()
    words = np.maximum(n, 1)
    hashes = word_hashes(p)
    order = np.lexsort((hashes, of))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    again = np.zeros(len(of), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    length = p.ends - p.starts
    marked = np.zeros(len(p.data) + 1, dtype=np.int64)
    np.cumsum(np.isin(_CLASS[p.data], (_SYMBOL, _BANG, _BAR)), out=marked[1:])
    per_word = lambda mask: np.bincount(of, weights=mask, minlength=rows) / words
    return np.column_stack(
        [
            np.log1p(n),
            per_word(length),
            count[:, _UPPER] / letters,
            count[:, _DIGIT] / chars,
            count[:, _SYMBOL] / chars,
            count[:, _BANG] / chars,
            count[:, _BAR] / chars,
            count[:, _STOP] / chars,
            count[:, _OTHER] / chars,
            count[:, _HIGH] / chars,
            np.bincount(of[order], weights=fresh, minlength=rows) / words,
            per_word(again),
            np.log1p(n / (count[:, _LINE] + 1)),
            per_word(length <= 3),
            per_word(length >= 12),
            per_word(marked[p.ends] > marked[p.starts]),
        ]
    )


def features(column: pa.Array) -> np.ndarray:
    parts = [_features(p) for p in pieces(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Model:
    """Look-up tables of the additive model; ``edges`` cut a feature into bins."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)] if self.pairs else []
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts halfway between neighbouring values, close to equal counts."""
    found = np.unique(values)
    if len(found) < 2:
        return np.zeros(0)
    at = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    at = at[at < found[-1]]
    after = found[np.searchsorted(found, at, side="right")]
    return (at + after) / 2


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray) -> int | None:
    """The best place to cut a run of bins in two, or None when no cut helps."""
    if len(g) < 2:
        return None
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    better = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    best = int(np.argmax(better))
    return best + 1 if better[best] > 1e-6 else None


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values, per bin, of a shallow tree over ordered bins."""
    at = _cut(g, h) if depth else None
    if at is None:
        return np.full(len(g), g.sum() / (h.sum() + 1.0))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Cut one feature, then the other one on each side; the better order wins. Also returns its gain."""
    best = None
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        at = _cut(gg.sum(axis=1), hh.sum(axis=1)) or max(1, len(gg) // 2)
        value = np.zeros_like(gg)
        gain = 0.0
        for rows in (slice(0, at), slice(at, len(gg))):
            sg, sh = gg[rows].sum(axis=0), hh[rows].sum(axis=0)
            leaf = _tree(sg, sh, 1)
            value[rows] = leaf
            gain += float((leaf * sg).sum())
        if best is None or gain > best[1]:
            best = (value.T if turned else value, gain)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 32, n_pairs: int = 6) -> Model:
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    edges = [_edges(x[:, j], bins) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if len(np.unique(y)) < 2:
        return Model(base, edges, tables, [], [], [])
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    total = np.full(len(y), base)
    for _ in range(rounds):
        for j, b in enumerate(binned):
            if len(tables[j]) < 2:
                continue
            p = 1 / (1 + np.exp(-total))
            g = np.bincount(b, weights=y - p, minlength=len(tables[j]))
            h = np.bincount(b, weights=p * (1 - p), minlength=len(tables[j]))
            step = rate * np.clip(_tree(g, h), -4, 4)
            tables[j] += step
            total += step[b]
    pair_edges = [_edges(x[:, j], 8) for j in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(pair_edges)]

    def sums(a: int, b: int, of: np.ndarray) -> np.ndarray:
        shape = (len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)
        return np.bincount(coarse[a] * shape[1] + coarse[b], weights=of, minlength=shape[0] * shape[1]).reshape(shape)

    p = 1 / (1 + np.exp(-total))
    usable = [j for j, e in enumerate(pair_edges) if len(e)]
    strength = {
        (a, b): _pair_tree(sums(a, b, y - p), sums(a, b, p * (1 - p)))[1] for i, a in enumerate(usable) for b in usable[i + 1 :]
    }
    pairs = sorted(strength, key=lambda k: (-strength[k], k))[:n_pairs]
    pair_tables = [np.zeros((len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)) for a, b in pairs]
    for _ in range(rounds // 2):
        for table, (a, b) in zip(pair_tables, pairs, strict=True):
            p = 1 / (1 + np.exp(-total))
            step = rate * np.clip(_pair_tree(sums(a, b, y - p), sums(a, b, p * (1 - p)))[0], -4, 4)
            table += step
            total += step[coarse[a], coarse[b]]
    return Model(base, edges, tables, pairs, pair_edges, pair_tables)


def fold(id_col: str = "doc_id") -> Column:
    """0 for the held-out fifth: the CRC-32 of the id's text modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % 5


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
) -> Model:
    """Fit on labelled documents outside the held-out fold, at most ``max_labelled`` of them.

    Of rows that share a labelled id, the one with the smallest features counts, so no more rows than that reach the driver.
    """
    bound_batches(docs.sparkSession)
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y"))
        .where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & (fold("_id") != 0))
        .groupBy("_id")
        .agg(F.min("_y").cast("double").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_labelled)
    )
    # At most ``max_labelled`` rows of two numbers, so this side can always be sent to every executor.
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("_text"))
            yield pa.record_batch(
                [batch.column("_id").cast(pa.string()), batch.column("_y"), *(pa.array(c) for c in x.T)], names=["_id", "_y", *FEATURES]
            )

    schema = ", ".join(["_id string", "_y double", *(f"{f} double" for f in FEATURES)])
    measured = found.select("_id", "_y", "_text").mapInArrow(run, schema)
    rows = measured.groupBy("_id").agg(F.min(F.struct("_y", *FEATURES)).alias("r")).select("_id", "r.*").toPandas()
    rows = rows.sort_values(["_id", "_y", *FEATURES], kind="stable")
    return fit(rows[list(FEATURES)].to_numpy(float), rows["_y"].to_numpy(float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(model.score(x), pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose text scores at least ``threshold``, with all their columns."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(batch.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
