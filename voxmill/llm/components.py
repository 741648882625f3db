"""Connected components of a table of links, by rounds of joins until nothing moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from voxmill.operators.scale import materialised


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id in ``links`` (``a, b``): the smallest id that can be reached.

    Every id starts with the smallest of itself and its neighbours. In a round it takes the smallest among the label of its
    label and the labels of its neighbours, so labels travel twice as far each time, and the number of rounds grows with the
    logarithm of the longest chain. Links and labels are written to the shared folder; the joins' sides are plain scans
    of them, so Spark can split the partition of an id with very many links.
    """
    forward = links.select("a", "b").where("a <> b")
    edges = materialised(forward.unionByName(forward.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = materialised(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        known = labels.select(F.col("id").alias("b"), F.col("component").alias("near"))
        nearest = edges.join(known, "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        moved = labels.join(jump, "component").join(nearest, "id")
        label = F.least("component", "far", "near")
        seen = Observation()
        step = moved.select("id", label.alias("component"), (label < F.col("component")).alias("changed"))
        step = step.observe(seen, F.count_if("changed").alias("changed")).drop("changed")
        labels = materialised(step, "labels")
        if not seen.get["changed"]:
            return labels
