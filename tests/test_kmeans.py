"""K-means of many groups at once against ``pyspark.ml`` and against Lloyd's rule."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.config import Config
from voxmill.operators import kmeans, themes

GROUPS = ("one", "two", "three")
SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("g", T.StringType()), T.StructField("features", VectorUDT())])


def _rows(seed: int, n: int, sparse: bool) -> list[tuple]:
    """Vectors without structure, which take k-means many iterations; some are repeated."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.normal(size=6) * (rng.random(6) < 0.6 if sparse else 1)
        made = Vectors.sparse(6, [(j, float(v)) for j, v in enumerate(x) if v]) if sparse else Vectors.dense(x.tolist())
        rows += [(i, GROUPS[i % 3], made)] * (1 + i % 4 // 3)
    return rows


def _first(spark, points, group, seed, k=4):
    own = points.where(F.col("g") == group)
    return np.array(KMeans(k=k, seed=seed, initMode="random", weightCol="weight", maxIter=0).fit(own).clusterCenters())


@pytest.mark.parametrize("sparse", [False, True])
def test_settled_centres_are_those_of_the_library(spark, sparse, monkeypatch):
    monkeypatch.setattr(kmeans, "BLOCK_ENTRIES", 64)
    monkeypatch.setattr(kmeans, "POINTS_PER_TASK", 50)
    df = spark.createDataFrame(_rows(3, 360, sparse), SCHEMA).repartition(3)
    points = themes.distinct_vectors(df, "g").persist()
    starts = {g: {a: _first(spark, points, g, 5 + a) for a in range(2)} for g in GROUPS}
    # Centres of one group in a turn, and of all.
    for limit in (1, 1 << 24):
        monkeypatch.setattr(kmeans, "FIT_BYTES", limit)
        got = kmeans.settle(points, "g", "features", starts, 300)
        assert set(got) == set(GROUPS)
        for g in GROUPS:
            own = points.where(F.col("g") == g)
            made = [KMeans(k=4, seed=5 + a, initMode="random", weightCol="weight", maxIter=300).fit(own) for a in range(2)]
            best = min(made, key=lambda m: m.summary.trainingCost)
            assert np.allclose(got[g], np.array(best.clusterCenters()), atol=1e-9)
            placed = df.where(F.col("g") == g).select("id", "features", kmeans.nearest(df, "g", "features", got).alias("c"))
            assert {(r.id, r.c) for r in placed.collect()} == {(r.id, r.prediction) for r in best.transform(df.where(F.col("g") == g)).collect()}
    assert kmeans.settle(points, "g", "features", {"one": {0: starts["one"][0]}}, 0)["one"].tolist() == starts["one"][0].tolist()


def test_all_zero_vectors_and_mixed_forms_find_their_centres(spark):
    rows = [(0, "a", Vectors.sparse(2, [])), (1, "a", Vectors.dense([0.0, 3.0])), (2, "a", Vectors.sparse(2, [(1, 3.0)])), (3, "b", Vectors.dense([1.0, 1.0])), (4, "a", Vectors.sparse(2, []))]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    centres = {"a": np.array([[0.0, 2.0], [0.1, 0.1]])}
    placed = df.select("id", kmeans.nearest(df, "g", "features", centres).alias("c"))
    assert {r.id: r.c for r in placed.collect()} == {0: 1, 1: 0, 2: 0, 3: 0, 4: 1}
    points = themes.distinct_vectors(df, "g")
    assert kmeans.settle(points, "g", "features", {"a": {0: centres["a"]}}, 10)["a"].tolist() == [[0.0, 3.0], [0.0, 0.0]]


def test_iterations_are_shared_by_groups_and_restarts(spark):
    rows = [(i, f"{g}{i % 6}", v) for i, g, v in _rows(4, 900, False)]
    df = spark.createDataFrame(rows, SCHEMA)
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()

    def jobs(iterations: int) -> int:
        before = scheduler.numTotalJobs()
        themes.cluster_within(df, "g", cfg=Config(kmeans_max_iter=iterations))
        return scheduler.numTotalJobs() - before

    # Six groups with five restarts each: an iteration more is one job more, not one for every fit.
    assert jobs(9) - jobs(1) == 8
