"""Drift from stored quantile sketches: one sketch per batch, merged per window, no value kept for a row.

A sketch is Spark's KLL sketch of doubles. Sketches of batches merge to the sketch of all their rows, so a window of any length is
compared with a baseline from a few kilobytes a batch. ``share_error`` states how far the share of rows between two values may be
off, and ``psi_from_sketches`` carries that through to the index. Batches of fewer rows than ``k`` are exact.

Null values count nowhere. A batch without values has no sketch; a window without any is not in the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.operators.drift import SHARE_FLOOR, drift_status

K = 4096


def share_error(k: int = K) -> float:
    """The error of a share between two values, with a confidence of 99%: twice the published rank error of a sketch of size ``k``."""
    return 2 * 2.296 / k**0.9021


def sketch(df: DataFrame, column: str, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """``by, sketch``: one sketch for each value of ``by``, combined before the shuffle."""
    values = df.select(*by, F.col(column).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return values.groupBy(*by).agg(F.kll_sketch_agg_double("_v", k).alias("sketch")).where(F.kll_sketch_get_n_double("sketch") > 0)


def merge(sketches: DataFrame, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """``by, sketch, n`` of all rows behind the sketches."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))
    return merged.select(*by, "sketch", F.kll_sketch_get_n_double("sketch").alias("n")).where(F.col("n") > 0)


def save_sketches(sketches: DataFrame, path: str, batch: str = "batch") -> None:
    """Store sketches by their ``batch`` column; a batch that is stored again replaces itself, others stay."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(path)


def stored_sketches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``save_sketches`` has stored, or an empty table of this schema."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in (exc.getCondition() or ""):
            raise
        return spark.createDataFrame([], schema)


def psi_from_sketches(expected: DataFrame, actual: DataFrame, by: Sequence[str] = (), bins: int = 10, k: int = K) -> DataFrame:
    """``by, n, psi, psi_error, status, degenerate``: each sketch of ``actual`` (``by, sketch, n``) against the one row of ``expected``.

    Bins are those of ``drift.psi``: half-open, between the quantiles of the expected values. The index from all values lies within
    ``psi_error`` of ``psi`` where the bins' shares are within ``share_error``. Without an expected sketch the index is null.
    """
    base = expected.select("sketch", F.kll_sketch_get_n_double("sketch").alias("n")).first()  # one row, a sketch
    figures = [*by, "n", F.lit(None).cast("double").alias("psi"), F.lit(None).cast("double").alias("psi_error"), F.lit(False).alias("degenerate")]
    if base is None:
        return actual.select(*figures).withColumn("status", drift_status(F.col("psi")))
    error = share_error(k) / 2
    # An edge is a quantile between two values, and known to a rank error: the values at both ends of that stretch enclose it.
    slack = error + 1 / base["n"]
    asked = [min(1.0, max(0.0, i / bins + d * slack)) for d in (-1, 0, 1) for i in range(bins + 1)]
    # A row of three times as many numbers as there are edges.
    found = expected.select(F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(q) for q in asked])).alias("q")).first()["q"]
    low, middle, high = (found[i * (bins + 1) : (i + 1) * (bins + 1)] for i in range(3))
    inner = [i for i in range(1, bins + 1) if middle[i] != middle[i - 1] and middle[i] != middle[-1]]
    if not inner:
        none = [*by, "n", F.lit(0.0).alias("psi"), F.lit(0.0).alias("psi_error"), F.lit(True).alias("degenerate")]
        return actual.select(*none).withColumn("status", drift_status(F.col("psi")))

    def below(column: Column, edges: list[float], off: float = 0.0) -> Column:
        # The rank counts values up to its argument; the next smaller number leaves the edge itself out.
        ranks = F.kll_sketch_get_rank_double(column, F.array(*[F.lit(math.nextafter(edges[i], -math.inf)) for i in inner]))
        inside = F.transform(ranks, lambda r: F.greatest(F.lit(0.0), F.least(F.lit(1.0), r + off)))
        return F.concat(F.array(F.lit(0.0)), inside, F.array(F.lit(1.0)))

    def shares(upper: Column, lower: Column) -> Column:
        return F.zip_with(F.slice(upper, 2, len(inner) + 1), F.slice(lower, 1, len(inner) + 1), lambda hi, lo: hi - lo)

    own, at = F.lit(base["sketch"]), F.col("sketch")
    lows, highs = below(at, low, -error), below(at, high, error)
    columns = {"e": shares(below(own, middle), below(own, middle)), "a": shares(below(at, middle), below(at, middle)), "lo": shares(lows, highs), "hi": shares(highs, lows)}
    both = actual.select(*by, "n", F.arrays_zip(*[c.alias(name) for name, c in columns.items()]).alias("_s"))

    def term(e: Column, a: Column) -> Column:
        e, a = F.greatest(e, F.lit(SHARE_FLOOR)), F.greatest(a, F.lit(SHARE_FLOOR))
        return (a - e) * F.log(a / e)

    def off(s: Column) -> Column:
        # The term is convex in both shares, so over a box it is farthest off in a corner, or down to zero.
        here = term(s["e"], s["a"])
        ends = [s["e"] - 2 * slack, s["e"] + 2 * slack]
        corners = [F.abs(term(e, a) - here) for e in ends for a in (s["lo"], s["hi"])]
        return F.greatest(*corners, F.when((s["lo"] <= ends[1]) & (ends[0] <= s["hi"]), here).otherwise(0.0))

    add = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    psi, bound = add(F.transform("_s", lambda s: term(s["e"], s["a"]))), add(F.transform("_s", off))
    found = both.select(*by, "n", psi.alias("psi"), bound.alias("psi_error"), F.lit(False).alias("degenerate"))
    return found.withColumn("status", drift_status(F.col("psi")))
