"""Connected components of an undirected edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def components(links: DataFrame, most: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``links`` (a, b).

    Every round, each node hands the smallest label it knows to its neighbours and to the label's own
    node (so that labels jump along chains); labels meet by an aggregate with a map-side part, so a
    node of any degree is one row a task.  Rounds stop when no label changes.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = store.written(both, "graph-edges")
    labels = store.written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"), "graph-labels")
    for _ in range(most):
        known = labels.select(F.col("node").alias("a"), "component")
        heard = both.join(known, "a").select(F.col("b").alias("node"), "component")
        # the label's own node hears what its members have heard, and members hear of its label
        parent = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = labels.join(parent, "component").select("node", F.col("above").alias("component"))
        hooks = heard.join(labels.withColumnRenamed("component", "own"), "node").where("component < own").select(F.col("own").alias("node"), "component")
        new = heard.unionByName(jumped).unionByName(hooks).unionByName(labels).groupBy("node").agg(F.min("component").alias("component"))
        old, labels = labels, store.written(new, "graph-labels")
        changed = labels.join(old.withColumnRenamed("component", "was"), "node").where("component < was").limit(1).count()
        if not changed:
            return labels
    raise RuntimeError("labels still change; raise the number of rounds")
