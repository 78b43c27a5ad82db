"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daqframe.llm.session import checkpointed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every linked node; component is the smallest node that it can reach.

    Each round a node takes the smallest label among its own and its neighbours', then the label of that label.
    Jumping halves the way to the smallest node, so rounds grow with the logarithm of a component's width.
    Partial aggregation meets a hub's neighbours before the shuffle.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = checkpointed(links.union(links.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).select("node", F.least("node", "component").alias("component"))
    labels = checkpointed(labels)
    while True:
        near = both.join(labels.select(F.col("node").alias("a"), "component"), "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        step = checkpointed(step.join(jump, "next").select("node", "component", F.least("next", "far").alias("next")))
        changed = step.where("next <> component").limit(1).count()
        labels = step.select("node", F.col("next").alias("component"))
        if not changed:
            return labels
