"""Document fingerprints: a homomorphic hash of the multiset of paragraphs. Spark expressions only.

Every paragraph (what lies between line breaks, empty ones included) is hashed to a wide vector, and the fingerprint of a document is
the sum of its paragraphs' vectors, lane by lane modulo 2**32. So the order of paragraphs does not matter, repeated ones count, and a
paragraph is inserted or deleted by ``add`` or ``subtract`` without looking at the rest of the text.

Lanes of a paragraph:

- 16 lanes of its hash (two 64-bit hashes of the whole paragraph, expanded): together they tell different multisets apart. Texts that differ share all of
  them with a chance of about 2**-128 a pair.
- its number of word pairs, and for each of 64 bits how many of its pairs (a word and the next one) have this bit in their hash. Centred
  at half of the pairs these are sums of random signs, so the cosine of two documents' lanes estimates the cosine of their counts of word
  pairs, within about 0.1. That is ``likeness``; it needs the fingerprints alone.

A fingerprint is an array of 41 longs with two lanes each: 8 of hashes, 1 with the number of pairs, 32 of bits.

Case by case: a null paragraph is an empty one; no paragraphs at all give the zero vector. Empty fingerprints are alike (1) if they are
equal and unlike (0) anything else. A document is never collected: its paragraphs become rows, summed before the shuffle. Counts
stay exact below 2**31 pairs a document. Empty tables give empty results. Columns besides the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_LANES = 16
BITS = 64
HALF = BITS // 2
LANE = (1 << 32) - 1
# Bits i and i + 32 of a hash, each in a lane of its own.
_TWO = (1 << 32) | 1
_END = "\n"


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text; an empty or null one has one, which is empty."""
    return F.split(F.coalesce(text, F.lit("")), _END)


def _elements(paragraph: Column) -> Column:
    """The paragraph itself, marked by a line break, and each of its words with the next one (null after the last)."""
    words = F.split(F.translate(paragraph, "\t\x0b\x0c\r", "    "), " ")
    return F.arrays_zip(F.concat(F.array(paragraph), words).alias("a"), F.concat(F.array(F.lit(_END)), F.slice(words, 2, F.size(words))).alias("b"))


def _packed(low: Column, high: Column) -> Column:
    return F.shiftleft(high.bitwiseAND(F.lit(LANE)), 32).bitwiseOR(low.bitwiseAND(F.lit(LANE)))


def _low(word: Column) -> Column:
    return word.bitwiseAND(F.lit(LANE))


def _high(word: Column) -> Column:
    return F.shiftrightunsigned(word, 32)


def fingerprints(rows: DataFrame, keys: Sequence[str], paragraphs_col: str) -> DataFrame:
    """``keys, fingerprint``: one row for each value of ``keys`` among the rows, whose paragraphs are all summed."""
    lines = rows.select(*keys, F.explode_outer(paragraphs_col).alias("__vx_line"), F.size(paragraphs_col).alias("__vx_size"))
    # A row without paragraphs stays, with nothing to add.
    line = F.when(F.col("__vx_size") > 0, F.coalesce("__vx_line", F.lit("")))
    pairs = lines.select(*keys, F.inline_outer(_elements(line)).alias("__vx_a", "__vx_b"))
    whole = F.coalesce(F.col("__vx_b") == _END, F.lit(False))
    counted = F.col("__vx_a").isNotNull() & ~whole
    hashed = pairs.select(
        *keys, counted.alias("__vx_pair"), F.when(counted, F.xxhash64("__vx_a", "__vx_b")).otherwise(0).alias("__vx_h"),
        *[F.when(whole, F.xxhash64(F.lit(i), "__vx_a")).alias(f"__vx_w{i}") for i in range(2)],
    )
    lane = [_low(F.xxhash64("__vx_w0", "__vx_w1", F.lit(i))) for i in range(HASH_LANES)]
    equal = [F.sum(F.when(F.col("__vx_w0").isNotNull(), x).otherwise(0)).alias(f"__vx_e{i}") for i, x in enumerate(lane)]
    bits = [F.sum(F.shiftrightunsigned("__vx_h", i).bitwiseAND(F.lit(_TWO))).alias(f"__vx_b{i}") for i in range(HALF)]
    sums = hashed.groupBy(*keys).agg(*equal, F.count_if("__vx_pair").alias("__vx_n"), *bits)
    halves = [_packed(F.col(f"__vx_e{i}"), F.col(f"__vx_e{i + HASH_LANES // 2}")) for i in range(HASH_LANES // 2)]
    return sums.select(*keys, F.array(*halves, F.col("__vx_n"), *[F.col(f"__vx_b{i}") for i in range(HALF)]).alias("fingerprint"))


def _lanewise(a: Column, b: Column, sign: int) -> Column:
    return F.zip_with(a, b, lambda x, y: _packed(_low(x) + sign * _low(y), _high(x) + sign * _high(y)))


def add(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return _lanewise(a, b, 1)


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint of ``a`` without the paragraphs of ``b``, which must be among them."""
    return _lanewise(a, b, -1)


def as_text(fingerprint: Column) -> Column:
    """Lower-case hex of all lanes."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def _centred(fingerprint: Column) -> Column:
    """Sums of signs, one for each of the bits."""
    n, words = F.get(fingerprint, HASH_LANES // 2), F.slice(fingerprint, HASH_LANES // 2 + 2, HALF)
    low = F.transform(words, lambda w: (2 * _low(w) - n).cast("double"))
    return F.concat(low, F.transform(words, lambda w: (2 * _high(w) - n).cast("double")))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """How alike two documents are in their word pairs, from 0 to 1; 1 if the fingerprints are equal, 0 for an empty one beside another."""
    x, y = _centred(a), _centred(b)
    size = F.sqrt(_dot(x, x) * _dot(y, y))
    return F.when(a == b, 1.0).when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(x, y) / size)))
