"""Numeric expressions: exact averages, whole percentages, vectors as arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``, inside lambdas as well.

    A plain column that is used inside a lambda would be computed again for every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clip_score(c: Column) -> Column:
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)), 4)


def exact_sum(score: Column) -> Column:
    """Sum of a four-decimal score as a decimal, so the result does not depend on row order."""
    return F.sum(score.cast("decimal(18,4)"))


def exact_mean(score: Column) -> Column:
    """Mean of a four-decimal score; null over no rows."""
    return F.try_divide(exact_sum(score).cast("double"), F.count(score).cast("double"))


def percent_ints(counts: list[Column]) -> list[Column]:
    """Whole percentages that sum to 100: largest remainder, ties to the earlier class, all 0 over nothing."""
    total = sum(counts[1:], counts[0])
    floors = [F.floor(F.try_divide(c * F.lit(100), total)).cast("int") for c in counts]
    # Remainders are compared as whole numbers (100 c mod total), so equal shares really tie.
    rests = [F.pmod(c * F.lit(100), F.greatest(total, F.lit(1))) for c in counts]
    missing = F.lit(100) - sum(floors[1:], floors[0])
    out = []
    for i, (whole, rest) in enumerate(zip(floors, rests)):
        ahead = [
            ((other >= rest) if j < i else (other > rest)).cast("int") for j, other in enumerate(rests) if j != i
        ]
        rank = sum(ahead[1:], ahead[0]) if ahead else F.lit(0)
        out.append(F.when(total == 0, F.lit(0)).otherwise(whole + (rank < missing).cast("int")))
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def vector_dot(vector: Column, b: Column) -> Column:
    """Dot product of an ML vector with an array; a sparse vector costs its own entries only.

    The terms left out are zeros and the others are added in the same order, so both forms give the same sum.
    """
    raw = F.unwrap_udt(vector)
    entries = F.zip_with(raw["indices"], raw["values"], lambda i, x: x * F.get(b, i).cast("double"))
    sparse = F.aggregate(entries, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(raw["type"] == 0, sparse).otherwise(dot(raw["values"], b))


def unit(v: Column) -> Column:
    """Vector divided by its length, which is never taken below 1e-9."""

    def scaled(values: Column) -> Column:
        norm = F.greatest(F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x)), F.lit(1e-9))
        return let(norm, lambda n: F.transform(values, lambda x: x / n))

    return let(v, scaled)
