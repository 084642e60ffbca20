"""Connected components as DataFrame rounds: neighbours' smallest labels, then pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.session import cut, discard


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label``: every node of ``edges`` with the smallest node that it is connected to.

    Each round is a join, a grouped minimum and a jump (a label takes its own label), so paths shorten by more than
    half a round. Rounds end in files in the shared folder, and only a count of changes reaches the driver. An empty
    table of edges gives an empty result; self-edges and repeated edges do no harm.
    """
    spark = edges.sparkSession
    both = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("m"))
        low = labels.join(near, labels.node == near.u).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        at = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        moved = cut(low.join(at, "label", "left").select("node", F.least("label", F.coalesce("jump", "label")).alias("label"), "old"))
        changed = moved.where("label <> old").limit(1).count()
        discard(spark, labels)
        labels = moved.select("node", "label")
        if not changed:
            discard(spark, both)
            return labels
