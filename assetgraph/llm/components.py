"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetgraph.llm.scratch import written


def connected(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a, b): root is the smallest vertex that v can reach.

    Each round takes the smallest label among a vertex and its neighbours, then the label of that
    label; rounds end when no label changes. Labels are written to the shared folder after each step.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "v"), "labels")
    while True:
        told = both.join(labels.withColumnsRenamed({"v": "b", "root": "near"}), "b").groupBy("a").agg(F.min("near").alias("near"))
        met = labels.join(told.withColumnRenamed("a", "v"), "v").select("v", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        met = written(met, "labels")
        jumped = met.join(met.select(F.col("v").alias("root"), F.col("root").alias("up")), "root")
        labels = written(jumped.select("v", F.col("up").alias("root"), (F.col("up") != F.col("old")).alias("moved")), "labels")
        if labels.where("moved").isEmpty():
            return labels.select("v", "root")
        labels = labels.select("v", "root")
