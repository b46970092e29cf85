"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``u long, v long`` -> ``node, comp``: the smallest node of its component, for each node with an edge.

    Labels only ever fall and each round halves the distance to the smallest node of a chain; the tables stay on
    the executors, and each round's labels are written to the shared folder.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()
    both = materialise(both, "edges")
    labels = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp"))
    labels = materialise(labels, "labels")
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("comp").alias("m"))
        step = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        up = step.select(F.col("node").alias("comp"), F.col("comp").alias("higher"))
        step = materialise(step.join(up, "comp").select("node", "old", F.least("comp", "higher").alias("comp")), "labels")
        labels = step.select("node", "comp")
        if step.filter("old <> comp").isEmpty():
            return labels
