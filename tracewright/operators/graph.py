"""Graphs as edge tables."""

from __future__ import annotations

import hashlib
import heapq
import os
import tempfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import hash_order


def canonical(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _checkpoints(spark: SparkSession) -> None:
    """Where lineage is cut: ``spark.checkpoint.dir``, or on one machine a folder of its own."""
    if spark.sparkContext.getConf().get("spark.checkpoint.dir", None) is None and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "tracewright-checkpoints"))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node reachable.  Labels spread to neighbours, jump to their label's
    label and hook the label's own node to what its members hear, until none changes; each round's table is checkpointed, so lineage stays short and a lost executor costs one round."""
    _checkpoints(edges.sparkSession)
    both = canonical(edges)
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node").checkpoint()
    changed = True
    while changed:
        heard = both.join(labels.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "component")
        above = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = labels.join(above, "component").select("node", F.col("above").alias("component"))
        hooks = heard.join(labels.withColumnRenamed("component", "own"), "node").where("component < own").select(F.col("own").alias("node"), "component")
        new = heard.unionByName(jumped).unionByName(hooks).unionByName(labels).groupBy("node").agg(F.min("component").alias("component")).checkpoint()
        changed = new.join(labels.withColumnRenamed("component", "was"), "node").where("component < was").limit(1).count()
        labels = new
    if nodes is None:
        return labels
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_stats(labels: DataFrame) -> DataFrame:
    """Nodes, components, the largest one and its share."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(F.sum("size").alias("nodes"), F.count(F.lit(1)).alias("components"), F.max("size").alias("largest")).withColumn("largest_rate", F.col("largest") / F.col("nodes"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    keep = nodes.select("node")
    return edges.join(keep.withColumnRenamed("node", "a"), "a", "left_semi").join(keep.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")


def degrees(edges: DataFrame) -> DataFrame:
    e = canonical(edges)
    return e.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def unique_resolve(references: DataFrame, targets: DataFrame) -> DataFrame:
    """``references`` (source, key) joined with ``targets`` (key, path) where a key has one path only."""
    one = targets.groupBy("key").agg(F.countDistinct("path").alias("paths"), F.min("path").alias("path"))
    return references.join(one, "key", "left").select("source", "key", F.when(F.col("paths") == 1, F.col("path")).alias("path"), F.coalesce("paths", F.lit(0)).alias("paths"))


def distances(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(graph, node, steps, before): the least number of steps from each graph's start, up to ``most``, and
    the least node before it on such a path.  ``edges`` (graph, a, b) go both ways; one join a step, of the
    last step's front only; what is known is checkpointed."""
    _checkpoints(edges.sparkSession)
    both = edges.select("graph", "a", "b").unionByName(edges.select("graph", F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    none = F.lit(None).cast(starts.schema["node"].dataType)
    known = starts.select("graph", "node", F.lit(0).alias("steps"), none.alias("before"))
    front = known = known.checkpoint()
    for step in range(1, most + 1):
        near = front.select("graph", F.col("node").alias("a")).join(both, ["graph", "a"]).groupBy("graph", F.col("b").alias("node")).agg(F.min("a").alias("before"))
        front = near.join(known.select("graph", "node"), ["graph", "node"], "left_anti").select("graph", "node", F.lit(step).alias("steps"), "before").checkpoint()
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def grown(edges: DataFrame, anchors: DataFrame, hard: DataFrame, size: int, most: int) -> DataFrame:
    """Fragments: of each graph its anchor (graph, node), the nearest hard nodes (ties by node) up to
    ``size`` with it, and the connectors on their paths to the anchor.  (graph, node, role)"""
    reached = distances(edges, anchors, most)
    place = F.row_number().over(Window.partitionBy("graph").orderBy("steps", "node"))
    picked = reached.join(hard.select("graph", "node"), ["graph", "node"], "left_semi").where("steps > 0").withColumn("place", place).where(F.col("place") < size).drop("place").checkpoint()
    roles = anchors.select("graph", "node", F.lit("ANCHOR").alias("role")).unionByName(picked.select("graph", "node", F.lit("HARD").alias("role")))
    way = picked
    for _ in range(most - 1):
        way = way.select("graph", F.col("before").alias("node")).distinct().join(reached, ["graph", "node"]).where("steps > 0").checkpoint()
        roles = roles.unionByName(way.select("graph", "node", F.lit("CONNECTOR").alias("role")))
    return roles.groupBy("graph", "node").agg(F.min("role").alias("as_one"), F.min(F.when(F.col("role") != "CONNECTOR", F.col("role"))).alias("own")).select("graph", "node", F.coalesce("own", "as_one").alias("role"))


def chained(labels: DataFrame, seed: str = "0") -> DataFrame:
    """Edges (graph, a, b) that connect each graph's components (graph, node, component): components in the
    hash order of their names, each joined to the next by their least nodes."""
    least = labels.groupBy("graph", "component").agg(F.min("node").alias("node"))
    order = Window.partitionBy("graph").orderBy(hash_order(F.col("component"), seed, "connect"), "component")
    return least.select("graph", F.col("node").alias("a"), F.lead("node").over(order).alias("b")).where("b is not null")


def reference_kinds(references: DataFrame, own: DataFrame, known: DataFrame) -> DataFrame:
    """Per source of ``references`` (source, owner, key): how many keys its owner's targets (owner, key)
    hold, how many others' do, and how many none's."""
    inside = own.select("owner", "key").distinct().withColumn("_own", F.lit(True))
    anywhere = known.select("key").distinct().withColumn("_any", F.lit(True))
    joined = references.distinct().join(inside, ["owner", "key"], "left").join(anywhere, "key", "left")
    here, there = F.col("_own").isNotNull(), F.col("_any").isNotNull()
    return joined.groupBy("source").agg(F.count_if(here).alias("internal"), F.count_if(~here & there).alias("external"), F.count_if(~there).alias("unresolved"))


def release_statistics(labels: DataFrame, hard: DataFrame) -> DataFrame:
    """Per graph of ``labels`` (graph, node, component): nodes, components, the share of the largest, and the
    share of the hard nodes (graph, node) that the largest covers (ties: the least component)."""
    sizes = labels.join(hard.select("graph", "node").withColumn("_hard", F.lit(1)), ["graph", "node"], "left").groupBy("graph", "component").agg(F.count(F.lit(1)).alias("size"), F.count("_hard").alias("hard"))
    largest = F.max_by(F.struct("size", "hard"), F.struct("size", -F.col("component")))
    out = sizes.groupBy("graph").agg(F.sum("size").alias("nodes"), F.count(F.lit(1)).alias("components"), F.sum("hard").alias("hard"), largest.alias("l"))
    return out.select("graph", "nodes", "components", (F.col("l.size") / F.col("nodes")).alias("largest_rate"), F.when(F.col("hard") > 0, F.col("l.hard") / F.col("hard")).otherwise(0.0).alias("hard_coverage"))


#: Fixed value: the seed of the published benchmark's orders.
CONNECT_SEED = "20260812"


def bridging(graph: str, components: list[list[str]], seed: str = CONNECT_SEED) -> list[tuple[str, str]]:
    """Edges that make one component of ``components`` (lists of names): the two whose digests come first are
    joined by their first nodes, the union takes its own place among the rest, until one is left."""
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    order = lambda node: (digest(f"{seed}|{graph}|component-node-order|{node}"), node)
    entry = lambda nodes, first: (digest(f"{graph}|{'|'.join(nodes)}"), first, nodes)
    heap, out = [entry(sorted(c), min(map(order, c))) for c in components], []
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, one = heapq.heappop(heap)
        _, b, two = heapq.heappop(heap)
        out.append((min(a[1], b[1]), max(a[1], b[1])))
        heapq.heappush(heap, entry(sorted(one + two), min(a, b)))
    return out


def connected(labels: DataFrame, seed: str = CONNECT_SEED) -> DataFrame:
    """Edges (graph, a, b; names as strings) that connect each graph's components (graph, node, component),
    by ``bridging``.  A graph is one query package or release; its nodes are read by one task."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        graph = rows["graph"].iloc[0]
        sides = rows.groupby("component")["node"].apply(list).tolist()
        return pd.DataFrame([(graph, a, b) for a, b in bridging(str(graph), sides, seed)], columns=["graph", "a", "b"])

    named = labels.select("graph", F.col("node").cast("string").alias("node"), F.col("component").cast("string").alias("component"))
    return named.groupBy("graph").applyInPandas(each, f"graph {labels.schema['graph'].dataType.simpleString()}, a string, b string")
