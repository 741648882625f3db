"""Drift of a batch against a stored baseline."""

from __future__ import annotations

from datetime import datetime, timezone

import numpy as np
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.operators.features import similarity_to
from voxmill.operators.scale import QUANTILE_DIRECT, exact_quantiles, materialised
from voxmill.sources.tables import read_baseline, save_baseline

SHARE_FLOOR = 1e-4
SUM_GROUPS = 64
INITIALIZED = "Baseline initialized"


def drift_status(psi: Column) -> Column:
    return F.when(psi.isNull(), "Unknown").when(psi < 0.10, "Low").when(psi < 0.25, "Moderate").otherwise("High")


def drift_display(psi: Column) -> Column:
    return F.concat(drift_status(psi), F.when(psi.isNull(), "").otherwise(F.format_string(" (%.2f)", psi)))


def psi(
    expected: DataFrame, actual: DataFrame, column: str = "similarity", bins: int = 10, direct: int = QUANTILE_DIRECT
) -> DataFrame:
    """Population stability index of one numeric column, one row (psi, degenerate).

    Bin edges are exact quantiles of ``expected``; bins are half-open, the outer ones unbounded. With fewer
    than three distinct edges the index is 0 and ``degenerate`` is set. An empty side has no shares: the index is null.
    """
    spark = expected.sparkSession
    edges = sorted(set(exact_quantiles(expected, column, [i / bins for i in range(bins + 1)], direct)))
    if len(edges) < 3:
        return spark.createDataFrame([(0.0, True)], "psi double, degenerate boolean")
    inner = edges[1:-1]

    def binned(df: DataFrame, name: str) -> DataFrame:
        value = F.col(column).cast("double")
        slot = sum(((value >= e).cast("int") for e in inner[1:]), (value >= inner[0]).cast("int"))
        return df.where(value.isNotNull()).groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias(name))

    # The axis has one row per bin, so bins without any row still count.
    axis = spark.range(len(inner) + 1).select(F.col("id").cast("int").alias("bin"))
    both = axis.join(binned(expected, "e"), "bin", "left").join(binned(actual, "a"), "bin", "left").fillna(0, ["e", "a"])
    totals = both.agg(
        F.array_sort(F.collect_list(F.struct("bin", "e", "a"))).alias("b"),
        F.sum("e").alias("et"),
        F.sum("a").alias("at"),
    )

    def part(row: Column) -> Column:
        e = F.greatest(F.try_divide(row["e"], F.col("et")), F.lit(SHARE_FLOOR))
        a = F.greatest(F.try_divide(row["a"], F.col("at")), F.lit(SHARE_FLOOR))
        return (a - e) * F.log(a / e)

    total = F.aggregate(F.transform("b", part), F.lit(0.0), lambda acc, x: acc + x)
    some = (F.col("et") > 0) & (F.col("at") > 0)
    return totals.select(F.when(some, total).alias("psi"), F.lit(False).alias("degenerate"))


def unit_centroid(df: DataFrame, vector: str = "features") -> list[float] | None:
    """Unit centroid of a whole table, or None when it is empty.

    Partial sums meet in at most ``SUM_GROUPS`` groups, and those sums on the driver, so no task gets all partials.
    """
    sums = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(SUM_GROUPS))).agg(Summarizer.sum(F.col(vector)).alias("s")).collect()
    if not sums:
        return None
    total = np.sum([r["s"].toArray() for r in sums], axis=0)
    length = float(np.linalg.norm(total))
    return (total / length if length else total).tolist()


def centroid_drift(baseline: DataFrame, current: DataFrame, vector: str = "features") -> DataFrame:
    """1 minus the cosine of both unit centroids, four decimals; a batch of vectors never leaves its partition."""
    b, c = unit_centroid(baseline, vector), unit_centroid(current, vector)
    return baseline.sparkSession.createDataFrame([(_distance(b, c),)], "centroid_cosine_distance double")


def _distance(b: list[float] | None, c: list[float] | None) -> float | None:
    return None if b is None or c is None else round(1.0 - sum(x * y for x, y in zip(b, c, strict=True)), 4) + 0.0


def similarities(df: DataFrame, center: list[float], vector: str = "features") -> DataFrame:
    """The column that drift compares, written once: eight bytes a row."""
    return materialised(df.select(similarity_to(F.col(vector), center).alias("similarity")), "similarities")


def embedding_drift(
    baseline: DataFrame, current: DataFrame, vector: str = "features", bins: int = 10, direct: int = QUANTILE_DIRECT
) -> DataFrame:
    """One row: index of the similarities to the baseline centroid, its status, and the centroid distance."""
    center = unit_centroid(baseline, vector)
    return drift_figures(center, similarities(baseline, center, vector), current, vector, bins, direct)


def drift_figures(
    center: list[float], base: DataFrame, current: DataFrame, vector: str = "features", bins: int = 10, direct: int = QUANTILE_DIRECT
) -> DataFrame:
    """``embedding_drift`` against a baseline known by its centroid and similarities."""
    index = psi(base, similarities(current, center, vector), "similarity", bins, direct)
    value = F.col("psi")
    return index.select(
        F.round("psi", 4).alias("psi"),
        drift_status(value).alias("status"),
        drift_display(value).alias("display"),
        F.lit(_distance(center, unit_centroid(current, vector))).cast("double").alias("centroid_cosine_distance"),
        "degenerate",
    )


def drift_report(
    spark: SparkSession,
    current: DataFrame,
    baseline_path: str,
    embedder: str,
    vector: str = "features",
    bins: int = 10,
    replace_baseline: bool = False,
    baseline_name: str = "default",
    creator: str = "",
    publish: bool = True,
) -> DataFrame:
    """Lifecycle around the stored baseline; always one row.

    Empty batch: Unknown. No baseline yet, or one that ``creator`` made itself: this batch becomes it. Built by another embedder
    or unreadable: Unavailable. Otherwise the drift figures with their source and size. Without ``publish`` the
    caller saves the baseline (``publish_baseline``) once its own results are safe.
    """
    schema = (
        "psi double, status string, display string, centroid_cosine_distance double, degenerate boolean,"
        " baseline_source string, baseline_size bigint, embedder string"
    )

    def fixed(status: str, display: str | None = None) -> DataFrame:
        row = (None, status, display or status, None, None, None, None, embedder)
        return spark.createDataFrame([row], schema)

    if current.isEmpty():
        return fixed("Unknown")
    center, base, source = read_baseline(spark, baseline_path, embedder, baseline_name, creator)
    if source == "missing":
        if publish:
            publish_baseline(current, baseline_path, embedder, vector, baseline_name, creator)
        return fixed(INITIALIZED)
    if base is None:
        result = fixed("Unavailable", "Unavailable (baseline unusable)")
    else:
        figures = drift_figures(center, base, current, vector, bins)
        size = base.count()
        # Figures are read before the baseline may be replaced below.
        rows = figures.select(
            "*", F.lit(source).alias("baseline_source"), F.lit(size).cast("bigint").alias("baseline_size"), F.lit(embedder).alias("embedder")
        ).collect()
        result = spark.createDataFrame(rows, schema)
    if replace_baseline:
        publish_baseline(current, baseline_path, embedder, vector, baseline_name, creator)
    return result


def publish_baseline(
    current: DataFrame, baseline_path: str, embedder: str, vector: str = "features", name: str = "default", creator: str = ""
) -> None:
    center = unit_centroid(current, vector)
    save_baseline(similarities(current, center, vector), center, baseline_path, embedder, datetime.now(timezone.utc), name, creator)
