"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmcforge.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is the smallest node it reaches.

    Each round takes the smallest label among a node's neighbours, then the label of that label;
    rounds are written to the shared folder and end when no label changes.  Chains shorten by
    doubling, so the rounds grow with the logarithm of the longest path."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                   .where("a <> b").distinct(), "edges")
    old = None
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        seen = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("seen")))
        nearer = labels.join(seen, "node").select("node", F.col("label").alias("was"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        now = written(nearer.join(jump, "label", "left")
                      .select("node", "was", F.coalesce(F.least("label", "next"), "label").alias("label")), "labels")
        changed = now.where("label <> was").limit(1).count()
        if old is not None:
            discard(old)
        labels, old = now.select("node", "label"), now
        if not changed:
            discard(both)
            return labels
