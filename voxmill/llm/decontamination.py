"""Benchmark decontamination by latent semantic retrieval.

Texts and benchmark items are words without ASCII punctuation, in lower case. A text is read in passages of ``PASSAGE`` words, one
starting every half passage; items longer than ``CHUNK`` words are several queries.

1. One pass counts in how many half passages of the whole corpus each benchmark word occurs. The rarest ``TERMS`` words of every query
   are the terms (beyond the first ``LEAST_TERMS`` only those in at most a share ``COMMON`` of all half passages); a term weighs one over the root of its count, which gives rare and common terms the same energy.
2. A second pass sums up the Gram matrix of the weighted passages of the whole corpus, term by term, in a table (at most terms x
   terms, added up before the shuffle). The randomised SVD works on it: a random start, then rounds of
   products that Spark computes from the table, each followed by an orthonormalisation, give the leading
   right singular vectors, the latent space.
3. A third pass projects every passage and takes as candidates the queries with a cosine of ``COSINE`` of which the passage holds at
   least ``COVERAGE`` of the latent weight.
4. Candidates are checked on the words around them in the same task: the longest common subsequence must hold ``SURE`` of the query's
   words; or ``LIKELY`` of them, while the heaviest common subsequence, in which a word weighs the logarithm of its rarity in the corpus, holds
   ``HEAVY`` of the query's weight: common words meet in order by chance, rare ones do not. If the benchmark has an answer column, such a
   paraphrase must hold three quarters of the answer's words in order as well.

The benchmark is the stated query set: it is walked in blocks of ``BLOCK`` queries, each of which is sent to the
executors; the corpus is never collected, joined or shuffled.

Null or empty texts match nothing and null or empty items are no queries. Repeated rows are judged one by one, ties go to
the smallest item id. Texts are read whole at any length. ``clean_documents`` passes all columns of the documents on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.arrow_text import NOT_ALNUM, Piece, bound_batches, pieces, word_hashes
from voxmill.operators.scale import materialised

PASSAGE = 32
HALF = PASSAGE // 2
CHUNK = 64
TERMS = 16
LEAST_TERMS = 4
COMMON = 0.001
RANK = 256
ROUNDS = 4
BLOCK = 512
COSINE = 0.3
COVERAGE = 0.15
SURE = 0.8
LIKELY = 0.5
HEAVY = 0.35
ITEM_WEIGHT = 10.0


@dataclass
class Query:
    """One chunk of a benchmark item: word hashes, those of its answer if there is one, and the words' rarity in the corpus."""

    item: int
    words: np.ndarray
    answer: np.ndarray
    rarity: np.ndarray | None = None


def _words(text: str) -> np.ndarray:
    found = [word_hashes(p) for p in pieces(pa.array([text]), lower=True, gaps=NOT_ALNUM)]
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def queries(rows: list[tuple[int, str, str | None]]) -> list[Query]:
    out = []
    for item, text, answer in rows:
        words = _words(text)
        last = _words(answer or "")
        cuts = list(range(0, max(1, len(words) - CHUNK // 4), CHUNK))
        for a, b in zip(cuts, [*cuts[1:], len(words)], strict=True):
            out.append(Query(item, words[a:b], last))
    return [q for q in out if len(q.words)]


class Vocabulary:
    """Sorted word hashes; ``find`` gives the number of each word, or -1."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = np.unique(words)
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.words >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known words and their numbers."""
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
        number = np.searchsorted(self.words, hashes[at])
        known = number < len(self.words)
        known[known] = self.words[number[known]] == hashes[at[known]]
        return at[known], number[known]


def _halves(p: Piece) -> np.ndarray:
    """For every row the number of its first half passage; half passages of a piece are numbered through, one spare after each row."""
    n = -(-np.diff(p.bounds) // HALF) + 1
    return np.concatenate([[0], np.cumsum(n)])


def _entries(p: Piece, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Half passage and term of every known word."""
    at, term = vocabulary.find(word_hashes(p))
    row = np.searchsorted(p.bounds, at, side="right") - 1
    return _halves(p)[row] + (at - p.bounds[row]) // HALF, term


def _passages(p: Piece, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, term and count, each pair once. Passage h is the half passages h and h + 1 of one row, and starts with the first."""
    terms = len(vocabulary.words)
    half, term = _entries(p, vocabulary)
    starts = np.zeros(int(_halves(p)[-1]) + 1, dtype=bool)
    starts[_halves(p)] = True
    second = ~starts[half]  # the first half passage of a row has none before it
    key = np.concatenate([half * terms + term, ((half - 1) * terms + term)[second]])
    key, n = np.unique(key, return_counts=True)
    return key // terms, key % terms, n


def document_counts(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many half passages of the corpus each word occurs, and how many there are."""
    size = len(vocabulary.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for p in pieces(batch.column(0), lower=True, gaps=NOT_ALNUM):
                half, term = _entries(p, vocabulary)
                total[:size] += np.bincount(np.unique(half * size + term) % size, minlength=size)
                total[size] += int(_halves(p)[-1]) - p.rows
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "n"])

    sums = docs.select("_text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(size + 1, dtype=np.int64)
    rows = sums.toArrow()  # one row for each benchmark word of the block
    out[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return out[:size], int(out[size])


def _pairs(passage: np.ndarray, term: np.ndarray, n: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the Gram matrix (numbered row by row) and their sums over some passages, sorted by passage."""
    _, first, count = np.unique(passage, return_index=True, return_counts=True)
    of = np.repeat(np.arange(len(count)), count)
    left = np.repeat(np.arange(len(passage)), count[of])
    inner = np.arange(len(left)) - np.repeat(np.cumsum(count[of]) - count[of], count[of])
    right = first[of][left] + inner
    cell, back = np.unique(term[left] * terms + term[right], return_inverse=True)
    return cell, np.bincount(back, weights=(n[left] * n[right]).astype(float), minlength=len(cell))


def gram(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``row, col, value``: how often terms share a passage, over the whole corpus."""
    size = len(vocabulary.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, values = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
            for p in pieces(batch.column(0), lower=True, gaps=NOT_ALNUM):
                cell, value = _pairs(*_passages(p, vocabulary), size)
                cells.append(cell)
                values.append(value)
            cell, back = np.unique(np.concatenate(cells), return_inverse=True)
            value = np.bincount(back, weights=np.concatenate(values), minlength=len(cell))
            # Sums over no cells are whole numbers.
            yield pa.record_batch([pa.array(cell // size), pa.array(cell % size), pa.array(value.astype(float))], names=["row", "col", "value"])

    found = docs.select("_text").mapInArrow(run, "row long, col long, value double")
    return materialised(found.groupBy("row", "col").agg(F.sum("value").alias("value")), "gram")


def _product(table: DataFrame, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The weighted Gram matrix times a basis, summed by Spark; the result has one row for each term."""
    shared = table.sparkSession.sparkContext.broadcast((weights, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        total, seen = np.zeros_like(b), np.zeros(len(b), dtype=bool)
        for batch in batches:
            row, col, value = (c.to_numpy() for c in batch.columns)
            order = np.argsort(row, kind="stable")
            row, col, value = row[order], col[order], value[order]
            # A few thousand cells at a time: each takes a row of the basis.
            for lo in range(0, len(row), 1 << 12):
                hi = lo + (1 << 12)
                own, at = np.unique(row[lo:hi], return_index=True)
                total[own] += np.add.reduceat(b[col[lo:hi]] * (w[row[lo:hi]] * w[col[lo:hi]] * value[lo:hi])[:, None], at)
            seen[row] = True
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at), pa.array([total[i].tobytes() for i in at], pa.binary())], names=["row", "sums"])

    out = np.zeros_like(basis)
    rows = table.mapInArrow(run, "row long, sums binary").toArrow()
    for r, s in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        out[r] += np.frombuffer(s)
    shared.unpersist()
    return out


def latent_space(table: DataFrame, weights: np.ndarray, items: np.ndarray, rank: int = RANK, rounds: int = ROUNDS) -> np.ndarray:
    """Leading right singular vectors of the weighted passages and the items (rows of weighted terms)."""
    terms = len(weights)
    rank = min(rank, terms)
    # One range of rows in each task, so that a row's sum comes from one or two tasks and what reaches the driver does not grow.
    table = materialised(table.repartitionByRange(8, "row", "col"), "gram-rows")
    times = lambda x: _product(table, weights, x) + ITEM_WEIGHT * items.T @ (items @ x)
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((terms, rank)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(times(basis))[0]
    small = basis.T @ times(basis)
    _, turn = np.linalg.eigh((small + small.T) / 2)
    return basis @ turn[:, ::-1]


def common_subsequence(query: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, all cells of a column at once as bits of one number."""
    masks: dict[int, int] = {}
    for i, w in enumerate(query.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(query)) - 1
    row = full
    for w in words.tolist():
        both = row & masks.get(w, 0)
        if both:
            row = (row + both | row - both) & full
    return len(query) - row.bit_count()


def heaviest_subsequence(query: np.ndarray, weights: np.ndarray, words: np.ndarray) -> float:
    """Weight of the heaviest common subsequence, a word of the text at a time."""
    best = np.zeros(len(query) + 1)
    for w in words[np.isin(words, query)]:
        best[1:] = np.maximum(best[1:], best[:-1] + np.where(query == w, weights, -np.inf))
        best = np.maximum.accumulate(best)
    return float(best[-1])


@dataclass
class Finder:
    """All that a task needs to find the queries of one block in a batch of texts."""

    queries: list[Query]
    vocabulary: Vocabulary
    projection: np.ndarray  # term weights times the latent space
    latent: np.ndarray  # queries in the latent space

    def _confirmed(self, q: Query, words: np.ndarray) -> float | None:
        share = common_subsequence(q.words, words) / len(q.words)
        if share >= SURE:
            return share
        if share >= LIKELY and heaviest_subsequence(q.words, q.rarity, words) >= HEAVY * q.rarity.sum():
            # Without an answer there is nothing more to ask for.
            if common_subsequence(q.answer, words) >= 0.75 * len(q.answer):
                return share
        return None

    def find(self, column: pa.Array) -> Iterator[tuple[int, int, float]]:
        """Row, item and share of the query's words, for every confirmed candidate."""
        norm = np.linalg.norm(self.latent, axis=1)
        for p in pieces(column, lower=True, gaps=NOT_ALNUM):
            passage, term, n = _passages(p, self.vocabulary)
            if not len(passage):
                continue
            words, halves = word_hashes(p), _halves(p)
            # Whole passages, a few thousand entries at a time.
            cuts = np.unique(np.append(np.searchsorted(passage, passage[:: 1 << 12]), len(passage)))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                ids, first = np.unique(passage[a:b], return_index=True)
                points = np.add.reduceat(self.projection[term[a:b]] * n[a:b, None], first)
                dots = points @ self.latent.T
                length = np.linalg.norm(points, axis=1)
                hit = (dots >= COSINE * length[:, None] * norm) & (dots >= COVERAGE * norm * norm) & (norm > 1e-9)
                yield from self._check(p, words, halves, ids, *np.nonzero(hit))

    def _check(self, p: Piece, words: np.ndarray, halves: np.ndarray, ids: np.ndarray, which: np.ndarray, query: np.ndarray) -> Iterator[tuple[int, int, float]]:
        best: dict[tuple[int, int], float] = {}
        for w, k in zip(which.tolist(), query.tolist(), strict=True):
            row = int(np.searchsorted(halves, ids[w], side="right")) - 1
            if row < 0:
                continue
            q, lo, hi = self.queries[k], p.bounds[row], p.bounds[row + 1]
            if best.get((row, q.item), 0.0) >= 1.0:
                continue
            start = lo + (ids[w] - halves[row]) * HALF
            share = self._confirmed(q, words[max(lo, start - len(q.words)) : min(hi, start + PASSAGE + len(q.words))])
            if share is not None and share > best.get((row, q.item), 0.0):
                best[row, q.item] = share
        for (row, item), share in best.items():
            yield p.first + row, item, share


def finder(docs: DataFrame, block: list[Query]) -> Finder:
    everything = Vocabulary(np.concatenate([q.words for q in block]))
    counts, halves = document_counts(docs, everything)
    chosen = []
    for q in block:
        number = np.searchsorted(everything.words, np.unique(q.words))
        number = number[np.lexsort((number, counts[number]))[:TERMS]]
        # Common words say nothing about a query that has others.
        rare = np.arange(len(number)) < LEAST_TERMS
        chosen.append(everything.words[number[rare | (counts[number] <= halves * COMMON)]])
    vocabulary = Vocabulary(np.concatenate(chosen))
    weights = 1 / np.sqrt(counts[np.searchsorted(everything.words, vocabulary.words)] + 1)
    items = np.zeros((len(block), len(vocabulary.words)))
    for i, q in enumerate(block):
        _, number = vocabulary.find(q.words)
        np.add.at(items[i], number, 1)
    items *= weights
    for q in block:
        q.rarity = np.log((halves + 2) / (counts[np.searchsorted(everything.words, q.words)] + 1)).clip(min=1e-3)
    space = latent_space(gram(docs, vocabulary), weights, items)
    return Finder(block, vocabulary, weights[:, None] * space, items @ space)


def finders(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, answer_col: str | None) -> Iterator[Finder]:
    """One finder for each block of at most ``BLOCK`` queries, in the order of the items."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("_text"))
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text"), answer.alias("answer"))
    items = items.where(F.col("item").isNotNull() & F.col("text").isNotNull()).distinct().orderBy("item", "text")
    block: list[Query] = []
    for row in items.toLocalIterator():
        block += queries([(row["item"], row["text"], row["answer"])])
        while len(block) >= BLOCK:
            yield finder(texts, block[:BLOCK])
            block = block[BLOCK:]
    if block:
        yield finder(texts, block)


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", answer_col: str | None = None,
) -> DataFrame:
    """``id, item_id, share``: one row for each document and each item found in it, with the share of the query's words."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id long, share double"
    out = spark.createDataFrame([], schema)
    for own in finders(docs, benchmark, text_col, item_col, item_text, answer_col):
        out = out.unionByName(docs.select(id_col, text_col).mapInArrow(_hits(spark.sparkContext.broadcast(own), id_col), schema))
    return out.groupBy(id_col, "item_id").agg(F.max("share").alias("share"))


def _hits(shared, id_col: str):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shared.value.find(batch.column(1)))
            rows, items, shares = zip(*found, strict=True) if found else ((), (), ())
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.record_batch([ids, pa.array(items, pa.int64()), pa.array(shares, pa.float64())], names=[id_col, "item_id", "share"])

    return run


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None
) -> DataFrame:
    """The rows of ``docs`` in which no item was found."""
    out, at = docs, docs.columns.index(text_col)

    for own in finders(docs, benchmark, text_col, item_col, item_text, answer_col):
        out = out.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(own), at), docs.schema)
    return out


def _clean(shared, at: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            keep[[row for row, _, _ in shared.value.find(batch.column(at))]] = False
            yield batch.filter(pa.array(keep))

    return run
