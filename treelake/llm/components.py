"""Connected components of a link graph, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, materialize


def components(edges: DataFrame) -> DataFrame:
    """id, label for every end of edges (a, b): label is the least id of its component.

    Every node hooks onto its least neighbour, chains are shortened twice by joins, and edges are contracted to the nodes
    they now lead to, until none is left; their number falls geometrically. Each round is written to the shared folder.
    """
    edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    ids = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    labels = materialize(ids.withColumn("label", F.col("id")), "labels")
    while edges.limit(1).count():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        parents = both.groupBy("v").agg(F.min(F.least("v", "u")).alias("p"))
        for _ in range(2):
            above = parents.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            parents = parents.join(above, "p").select("v", F.col("pp").alias("p"))
        parents = materialize(parents, "parents")
        left = edges.join(parents.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a")
        joined = left.join(parents.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        moved = joined.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        edges = materialize(moved, "edges")
        after = join_unique(labels, parents.select(F.col("v").alias("label"), F.col("p").alias("to")), "label")
        labels = materialize(after.select("id", F.coalesce("to", "label").alias("label")), "labels")
    return labels
