"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), longs -> (node, root): root is the smallest node that is reachable.

    Each round takes the least label of the neighbours and then the label's
    label, so paths shorten by doubling; sums and minima are combined before
    they are exchanged, and a hub's edges are one side of a plain join, which
    adaptive execution splits. Tables between rounds are written.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.union(both.select("v", "u")).union(both.select("u", "u")).union(both.select("v", "v"))
    both = materialize(both.distinct(), "edges")
    size = both.count()  # a bound of all that follows
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("label")), "labels", size)
    while True:
        step = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("label"), F.min(F.when(F.col("u") == F.col("v"), F.col("label"))).alias("was"))
        step = materialize(step, "steps", size)
        far = step.select(F.col("u").alias("label"), F.col("label").alias("next"))
        reached = materialize(step.join(far, "label").select("u", F.least("label", "next").alias("label"), "was"), "labels", size)
        release(labels, step)
        if not reached.filter("label <> was").limit(1).count():
            release(both)
            return reached.select(F.col("u").alias("node"), F.col("label").alias("root"))
        labels = reached
