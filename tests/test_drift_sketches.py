"""Stored quantile sketches: merging, shares, the index and its stated error."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.operators import drift
from voxmill.operators import drift_sketches as sketches


def frame(spark, days):
    return spark.createDataFrame([(d, float(v)) for d, values in days.items() for v in values], "day int, v double").repartition(4)


def test_batches_merge_to_the_sketch_of_all_rows(spark, tmp_path):
    rng = np.random.default_rng(0)
    days = {d: rng.normal(d / 10, 1, 3000) for d in range(8)}
    rows = frame(spark, days)
    path = f"{tmp_path}/s"
    sketches.save_sketches(sketches.sketch(rows.where("day < 5"), "v", ["day"], k=200), path, "day")
    sketches.save_sketches(sketches.sketch(rows.where("day >= 4"), "v", ["day"], k=200), path, "day")  # day 4 replaces itself
    stored = sketches.stored_sketches(spark, path, "sketch binary, day int")
    assert stored.count() == 8
    whole = sketches.merge(stored, k=200).first()
    assert whole["n"] == 24_000
    values = np.sort(np.concatenate(list(days.values())))
    edges = [-1.0, 0.0, 0.3, 1.5]
    ranks = sketches.merge(stored, k=200).select(F.kll_sketch_get_rank_double("sketch", F.array(*[F.lit(e) for e in edges]))).first()[0]
    assert np.abs(np.array(ranks) - np.searchsorted(values, edges, side="right") / len(values)).max() <= sketches.share_error(200) / 2
    assert sketches.stored_sketches(spark, f"{tmp_path}/none", "sketch binary, day int").count() == 0


@pytest.mark.parametrize(("k", "n"), [(4096, 500), (4096, 30_000), (200, 30_000)])
def test_index_is_within_the_stated_error(spark, k, n):
    rng = np.random.default_rng(n)
    base = rng.normal(0, 1, n)
    windows = {1: rng.normal(0, 1, n), 2: rng.normal(0.5, 1.2, n // 3), 3: np.round(rng.normal(0, 1, n // 2), 1), 4: np.full(60, 0.25)}
    expected = frame(spark, {0: base})
    actual = frame(spark, windows)
    merged = sketches.merge(sketches.sketch(actual, "v", ["day"], k), ["day"], k)
    found = {r.day: r for r in sketches.psi_from_sketches(sketches.merge(sketches.sketch(expected, "v", k=k), k=k), merged, ["day"], k=k).collect()}
    for day in windows:
        exact = drift.psi(expected, actual.where(F.col("day") == day), "v").first()["psi"]
        assert abs(found[day].psi - exact) <= found[day].psi_error
        assert found[day].n == len(windows[day])
    if k == 4096:
        assert found[1].psi_error < 0.1


def test_odd_sketches(spark):
    same = frame(spark, {0: [2.0] * 50})
    other = frame(spark, {1: [1.0, 2.0, 3.0]})
    actual = sketches.merge(sketches.sketch(other, "v", ["day"]), ["day"])
    row = sketches.psi_from_sketches(sketches.merge(sketches.sketch(same, "v")), actual, ["day"]).first()
    assert (row.psi, row.degenerate, row.status) == (0.0, True, "Low")
    nothing = spark.createDataFrame([(1, None), (2, float("nan"))], "day int, v double")
    assert sketches.sketch(nothing, "v", ["day"]).count() == 0
    none = sketches.psi_from_sketches(sketches.merge(sketches.sketch(nothing, "v")), actual, ["day"]).first()
    assert (none.psi, none.status) == (None, "Unknown")
