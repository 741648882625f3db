"""Skew-safe building blocks against plain definitions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.operators import scale


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dense_rows_are_dense_and_ordered_with_gaps_in_ids(spark):
    ids = sorted(random.Random(1).sample(range(10**9), 5000))
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(7)
    got = {r["id"]: r["row"] for r in scale.dense_rows(df, "id", width=1000).collect()}
    assert [got[i] for i in ids] == list(range(5000))


def test_scan_rows_number_a_file_scan_without_moving_a_row(spark, tmp_path):
    spark.range(0, 3000, 1, 5).withColumn("body", F.lit("x")).write.parquet(str(tmp_path / "t"))
    df = spark.read.option("maxPartitionBytes", 1000).parquet(str(tmp_path / "t"))
    numbered = scale.scan_rows(df, "pos")
    got = sorted(r["pos"] for r in numbered.collect())
    assert got == list(range(3000))
    # Only the counts of the splits go through an exchange: what stands below each one is a partial count or the sums of those.
    lines = _plan(numbered).splitlines()
    below = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line and i + 1 < len(lines)]
    assert below and all("partial_count" in line for line in below)


def test_salted_join_keeps_every_row_of_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}") for i in range(3000)] + [(9999, None)]
    big = spark.createDataFrame(rows, "id long, k string")
    side = big.select("k").dropna().distinct().withColumn("v", F.length("k"))
    joined = scale.salted_join(big, side, "k", "id").collect()
    assert len(joined) == len(rows)
    assert all((r["v"] is None) if r["k"] is None else r["v"] == len(r["k"]) for r in joined)


def test_salted_join_spreads_the_hot_key(spark):
    big = spark.range(4000).withColumn("k", F.when(F.col("id") % 2 == 0, "hot"))
    side = spark.createDataFrame([("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in scale.salted_join(big, side, "k", "id").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_small_table_returns_larger_tables_unchanged(spark):
    df = spark.range(50)
    same, small = scale.small_table(df, 49)
    assert not small and same is df
    copy, small = scale.small_table(df, 50)
    assert small and sorted(r[0] for r in copy.collect()) == list(range(50))


def test_top_n_limits_before_the_shuffle(spark):
    df = spark.range(10000).select((F.col("id") % 3).alias("g"), F.col("id"))
    top = scale.top_n(df, ["g"], [F.desc("id")], 2)
    assert "WindowGroupLimit" in _plan(top) and "Partial" in _plan(top)
    assert sorted(r["id"] for r in top.collect()) == [9994, 9995, 9996, 9997, 9998, 9999]


@pytest.mark.parametrize("offset,limit", [(0, 10), (95, 10), (990, 20), (1500, 10), (3, 0)])
def test_sorted_slice_deep_pages(spark, monkeypatch, offset, limit):
    monkeypatch.setattr(scale, "PAGE_DIRECT", 50)
    values = [(i % 7, i) for i in range(1000)]
    df = spark.createDataFrame(values, "s int, id long").repartition(6)
    got = scale.sorted_slice(df, [F.asc("s"), F.desc("id")], offset, limit)
    want = sorted(values, key=lambda v: (v[0], -v[1]))[offset : offset + limit]
    assert sorted((r["s"], r["id"]) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize(
    "values",
    [
        [float(i) for i in range(1000)],
        [0.5] * 700 + [float(i) for i in range(300)],
        [random.Random(3).gauss(0, 1e-6) + (1e6 if i % 5 == 0 else 0) for i in range(999)],
        [4.0] * 10,
        [1.0],
    ],
)
def test_exact_quantiles_by_counting_equal_the_direct_way(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    probs = [i / 10 for i in range(11)]
    counted = scale.exact_quantiles(df, "v", probs, direct=0)
    assert np.allclose(counted, np.quantile(values, probs), rtol=1e-12, atol=0)
    assert np.allclose(scale.exact_quantiles(df, "v", probs), counted, rtol=1e-12, atol=0)


def test_exact_quantiles_of_nothing(spark):
    assert scale.exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == []


def test_no_task_of_a_spread_table_reads_more_than_its_share(spark, tmp_path):
    """One large file, whose split would be one task, is dealt out by its size and not by the number of cores alone."""
    from voxmill.operators.scale import input_bytes, spread

    spark.range(200_000).selectExpr("id", "md5(cast(id as string)) AS text").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    cores, size = spark.sparkContext.defaultParallelism, input_bytes(df)
    assert size > 0 and spread(df).rdd.getNumPartitions() == 4 * cores
    share = size // (10 * cores)
    parts = spread(df, share).rdd.glom().map(len).collect()
    assert len(parts) >= 10 * cores and max(parts) < 2 * 200_000 / len(parts) + 100
    # Cut input is left alone only if its splits are as small as that.
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // (5 * cores)))
    try:
        assert spread(df, share).rdd.getNumPartitions() >= 10 * cores
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
