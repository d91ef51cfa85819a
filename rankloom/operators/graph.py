"""Largest connected set of entities that raters have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import checkpointed


def components(edges: DataFrame, key: str = "item") -> DataFrame:
    """``key, node, label`` from undirected ``key, i, j``: least-label propagation with pointer jumping, all keys at once."""
    both = checkpointed(edges.select(key, "i", "j").unionByName(edges.select(key, F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    labels = checkpointed(both.groupBy(key, F.col("i").alias("node")).agg(F.least(F.min("j"), F.first("i")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "j"), [key, "j"]).groupBy(key, F.col("i").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, [key, "node"]).select(key, "node", F.col("label").alias("old"), F.least("label", "near").alias("new"))
        jump = labels.select(key, F.col("node").alias("new"), F.col("label").alias("jumped"))
        moved = checkpointed(step.join(jump, [key, "new"], "left").select(key, "node", "old", F.least("new", F.coalesce("jumped", "new")).alias("label")))
        labels = moved.select(key, "node", "label")
        if moved.where("old <> label").isEmpty():
            return labels


def largest_set(edges: DataFrame, key: str = "item") -> DataFrame:
    """``key, entity_id`` of the largest component per key; at a tie the one with the smallest id. Entities without an edge drop out."""
    labels = components(edges, key)
    sizes = labels.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "label"))).where("r = 1").select(key, "label")
    return labels.join(best, [key, "label"], "left_semi").select(key, F.col("node").alias("entity_id"))
