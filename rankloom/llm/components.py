"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


#: Rows of a partition of the edge list, and least number of its partitions: one task would hold what it sorts for all the partitions that it takes together.
PART_ROWS, LEAST_PARTS = 50_000, 12


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a, b``, long); the component is its smallest node.

    Each round a node takes the least label of itself and its neighbours, and then
    the label of its label (pointer jumping), so long chains need few rounds. A round
    is two joins of narrow rows and is checkpointed, in as many partitions as the rows need; only the number of changed
    labels reaches the driver. Self loops and repeated edges do no harm, rows with a null end are
    left out, and no edges give no nodes.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = checkpoint(pairs)
    parts = max(LEAST_PARTS, 1 + 2 * pairs.count() // PART_ROWS)

    def kept(df: DataFrame) -> DataFrame:
        return checkpoint(df.coalesce(parts))

    both = kept(pairs.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v"))
    labels = kept(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        moved = step.join(jump, step["new"] == jump["n2"], "left").select("node", F.least("new", F.coalesce("l2", "new")).alias("label"), "old")
        moved = kept(moved)
        changed = moved.where("label <> old").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
