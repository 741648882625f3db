"""Spelling variants: words one edit apart, found by a scan of sorted permuterm rotations.

1. Words are counted (combined before the shuffle); from here on there is one row per distinct word.
2. Every word gets a terminator, and all its rotations are written. A word ``x c y`` has the rotation ``y . x c`` (``.`` is the
   terminator), so all words that differ from ``x y`` in one more letter at this place, and all that have another letter
   there, lie in the prefix range of ``y . x``: the range skips the edited letter, which is the last one of its members.
3. Rotations are dealt by ranges of their first letters, as many as the shortest word has, which all members of a prefix range share, and
   sorted. One scan keeps the ranges that are open at the moment on a stack, no deeper than a word is long.
4. When a range closes, each member learns how many neighbours it has in it and which of them is the most frequent. A range has a
   member for each letter of the alphabet at most and no pairs are written out, so the work is linear in the rotations.
5. Words add up what they learnt. A replacement is seen in one range only; a letter in a run of equal letters can be left out in several
   places, and counts where it is the first of its run.
6. Forms are followed to the last one by doubling pointers. Counts grow along a chain by ``ratio``, so there are no rings and few rounds.

Case by case: a null word or text holds no words. Equal words are counted together and ties go to the smaller word in code-point order.
Words may be of any length; a text or word is never cut. Empty tables give empty results. Columns besides those named are not read, so
their names do not matter. Words must not hold the terminator (U+0000); those that do are left out by ``count_words``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from voxmill.operators.scale import materialised

END = "\x00"
MIN_CHARS = 6
MIN_COUNT = 5
RATIO = 5
RUNS = "[a-zÀ-ÿ]+"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(text: str) -> Column:
    """The maximal runs of letters of a text column, A-Z lower-cased; none for a null."""
    return F.regexp_extract_all(F.translate(F.col(text), _CAPITALS, _SMALL), F.lit(RUNS), 0)


def count_words(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of a table of occurrences with a column ``word``."""
    long = words.where((F.length("word") >= min_chars) & ~F.contains("word", F.lit(END)))
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def rotations(counts: DataFrame) -> DataFrame:
    """``rotation, n``: a word of k letters has k + 1."""
    turned = F.transform(
        F.sequence(F.lit(0), F.length("word")), lambda i: F.concat(F.substring("word", i + 1, F.length("word")), F.lit(END), F.substring("word", F.lit(1), i))
    )
    return counts.select(F.explode(turned).alias("rotation"), "n")


class _Range:
    """An open prefix range: the word that ends with the prefix, if there is one, and those with one letter more."""

    __slots__ = ("members", "prefix")

    def __init__(self, prefix: str) -> None:
        self.prefix = prefix
        self.members: list[tuple[int, str]] = []

    def neighbours(self) -> Iterator[tuple[str, int, str, int]]:
        """``word, neighbours here, the most frequent of them, its count``."""
        here, last = len(self.prefix), self.prefix[-1]
        # (-n, word, role): 0 the word without the letter; 1 one with a letter; 2 one whose letter repeats the letter before.
        rows = []
        for minus_n, r in self.members:
            y, _, x = r.partition(END)
            rows.append((minus_n, x + y, 0 if len(r) == here else 2 if r[-1] == last else 1))
        rows.sort()
        # The word without the letter and the one whose letter repeats the letter before meet in the range of the first letter of that run.
        apart = {0: 2, 2: 0}
        roles = [role for _, _, role in rows]
        for i, (_, word, role) in enumerate(rows):
            other = apart.get(role)
            n = len(rows) - 1 - roles.count(other)
            if n:
                minus_n, near, _ = next(row for j, row in enumerate(rows) if j != i and row[2] != other)
                yield word, n, near, -minus_n


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rotations to what each word learns from each of its ranges."""
    stack: list[_Range] = []
    found: list[tuple[str, int, str, int]] = []

    def close() -> None:
        done = stack.pop()
        if len(done.members) > 1:
            found.extend(done.neighbours())

    def packed() -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
        found.clear()
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "here", "near", "near_n"])

    for batch in batches:
        for r, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            while stack and not r.startswith(stack[-1].prefix):
                close()
            if r[-1] != END:
                if not stack or len(stack[-1].prefix) < len(r) - 1:
                    stack.append(_Range(r[:-1]))
                stack[-1].members.append((-n, r))
            stack.append(_Range(r))
            stack[-1].members.append((-n, r))
        yield packed()
    while stack:
        close()
    yield packed()


def neighbours(counts: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``word, n_near, near, near_n`` of the words in ``counts`` (``word, n``, no shorter than ``min_chars``) that have a near one."""
    dealt = rotations(counts).repartitionByRange(F.substring("rotation", 1, min_chars)).sortWithinPartitions("rotation")
    learnt = dealt.mapInArrow(_scan, "word string, here long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    return learnt.groupBy("word").agg(F.sum("here").alias("n_near"), best.alias("b")).select("word", "n_near", "b.near", (-F.col("b.minus")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of the chain of every word in ``forms`` (``word, form``; without rings)."""
    ends = materialised(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step, seen = ends.select(F.col("word").alias("root"), F.col("root").alias("further")), Observation()
        moved = ends.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        ends = materialised(moved.observe(seen, F.count_if("moved").alias("moved")).drop("moved"), "roots")
        if not seen.get["moved"]:
            return ends


def group_variants(counts: DataFrame, ratio: int = RATIO, min_chars: int = MIN_CHARS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``counts`` (``word, n``, one row per word)."""
    counts = materialised(counts.where(F.length("word") >= min_chars).select("word", "n"), "word-counts")
    frequent = F.col("near_n") >= ratio * F.col("n")
    judged = counts.join(neighbours(counts, min_chars), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("near")).alias("form"), F.when(frequent, F.col("near_n")).alias("form_n"),
    )
    judged = materialised(judged, "word-forms")
    ends = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
