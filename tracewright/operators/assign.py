"""Assignment of components to parents: independent, by parent sets, smoothed over edges; votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import Method
from ..functions.text import jaccard


def independent(table: DataFrame) -> DataFrame:
    """Each node's cheapest eligible parent, ties by parent; null is UNKNOWN."""
    order = F.struct(F.round("cost", 9), F.col("parent"))
    best = F.min(F.when(F.col("eligible"), order))
    return table.groupBy("query_id", "node_id").agg(best.alias("best")).select("query_id", "node_id", F.col("best.parent").alias("parent"))


def _subsets(n: Column, most: int) -> Column:
    """All sets of at most ``most`` (three) of the ranks 1 to n, as structs (k, r1, r2, r3); -1: none."""
    ranks = F.sequence(F.lit(1), n)
    later = lambda r: F.filter(ranks, lambda x: x > r)
    none = F.lit(-1)
    of = lambda *rs: F.struct(F.lit(len(rs)).alias("k"), *[r.alias(f"r{i + 1}") for i, r in enumerate((*rs, none, none, none)[:3])])
    sets = [F.array(of()), F.transform(ranks, lambda i: of(i)), F.flatten(F.transform(ranks, lambda i: F.transform(later(i), lambda j: of(i, j))))]
    sets.append(F.flatten(F.transform(ranks, lambda i: F.flatten(F.transform(later(i), lambda j: F.transform(later(j), lambda k: of(i, j, k)))))))
    return F.concat(*sets[: most + 1])


def solve(table: DataFrame, pool: DataFrame, method: Method, by_size: bool = False) -> DataFrame:
    """The parent set of least assignment cost plus penalty for each parent; a node without an eligible
    parent of cost at most 1 costs 1.  ``by_size`` keeps the best set of each size.

    A query's costs by rank in its pool, whatever its size, are one row, in which the sets are enumerated:
    no join on sets.
    """
    ranked = table.join(pool.select("query_id", "parent", "rank"), ["query_id", "parent"], "left")
    usable = F.when(F.col("rank").isNotNull() & F.col("eligible") & (F.col("cost") <= 1), F.struct(F.col("rank").cast("int").alias("rank"), "cost"))
    rows = ranked.groupBy("query_id", "node_id").agg(F.collect_list(usable).alias("own"))
    rows = rows.groupBy("query_id").agg(F.collect_list("own").alias("owns"))  # the seven of a package
    listed = pool.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("rank").cast("int"), "parent"))).alias("parents"))
    n = F.size("parents")
    # costs by rank, then 1 for a place of the set that is not taken
    least = lambda own: lambda r: F.coalesce(F.array_min(F.transform(F.filter(own, lambda x: x["rank"] == r), lambda x: x["cost"])), F.lit(1.0))
    whole = rows.join(listed, "query_id").withColumn("rows", F.transform("owns", lambda own: F.concat(F.transform(F.sequence(F.lit(1), n), least(own)), F.array(F.lit(1.0)))))
    place = lambda r: F.when(r < 0, n + 1).otherwise(r)
    cost = lambda row, s: F.least(*[F.element_at(row, place(s[f"r{i}"])) for i in (1, 2, 3)])
    paid = lambda s: F.aggregate("rows", F.lit(0.0), lambda sum_, row: sum_ + cost(row, s))
    objective = lambda s: F.round(paid(s) + method.penalty * s["k"], 9)
    whole = whole.withColumn("sets", _subsets(n, method.most_parents))
    whole = whole.withColumn("tried", F.transform("sets", lambda s: F.struct(objective(s).alias("objective"), s["k"].alias("k"), s["r1"].alias("r1"), s["r2"].alias("r2"), s["r3"].alias("r3"))))
    if by_size:
        best = F.explode(F.transform(F.sequence(F.lit(0), F.least(n, F.lit(method.most_parents))), lambda k: F.array_min(F.filter("tried", lambda s: s["k"] == k))))
    else:
        best = F.array_min("tried")
    parent = lambda i: F.when(F.col(f"best.r{i}") > 0, F.element_at("parents", F.col(f"best.r{i}"))).alias(f"p{i}")
    return whole.select("query_id", "parents", best.alias("best")).select("query_id", "best.objective", "best.k", parent(1), parent(2), parent(3))


def assigned(table: DataFrame, sets: DataFrame) -> DataFrame:
    """Every node's cheapest eligible parent of its query's set; null is UNKNOWN."""
    chosen = table.join(sets, "query_id")
    member = F.coalesce((F.col("parent") == F.col("p1")) | (F.col("parent") == F.col("p2")) | (F.col("parent") == F.col("p3")), F.lit(False))
    usable = F.when(member & F.col("eligible") & (F.col("cost") <= 1), F.struct(F.round("cost", 9), F.col("parent")))
    return chosen.groupBy("query_id", "node_id").agg(F.min(usable).alias("best")).select("query_id", "node_id", F.col("best.parent").alias("parent"))


def smoothed(table: DataFrame, edges: DataFrame, beta: float, top: int = 3) -> DataFrame:
    """(query_id, node_id, parent, cost): costs drawn towards neighbours by the Jaccard weight of the two
    nodes' cheapest parents; eligibility stays as it was."""
    place = F.row_number().over(Window.partitionBy("query_id", "node_id").orderBy(F.round("cost", 9), "parent"))
    tops = table.withColumn("place", place).where(F.col("place") <= top).groupBy("query_id", "node_id").agg(F.collect_set("parent").alias("tops"))
    both = edges.select("query_id", "node_a", "node_b").unionByName(edges.select("query_id", F.col("node_b").alias("node_a"), F.col("node_a").alias("node_b")))
    weight = both.join(tops.select("query_id", F.col("node_id").alias("node_a"), F.col("tops").alias("ta")), ["query_id", "node_a"]).join(tops.select("query_id", F.col("node_id").alias("node_b"), F.col("tops").alias("tb")), ["query_id", "node_b"])
    weight = weight.select("query_id", "node_a", "node_b", jaccard(F.col("ta"), F.col("tb")).alias("w")).where("w > 0")
    near = weight.join(table.select("query_id", F.col("node_id").alias("node_b"), "parent", F.col("cost").alias("c")), ["query_id", "node_b"])
    mean = near.groupBy("query_id", F.col("node_a").alias("node_id"), "parent").agg((F.sum(F.col("w") * F.col("c")) / F.sum("w")).alias("near"))
    out = table.join(mean, ["query_id", "node_id", "parent"], "left")
    return out.withColumn("cost", F.when(F.col("near").isNull(), F.col("cost")).otherwise((1 - beta) * F.col("cost") + beta * F.col("near"))).drop("near")


def votes(table: DataFrame) -> DataFrame:
    """Per query and parent: fractional votes of each node's best ties, the same by confidence, and the
    sums of reciprocal and of normalised ranks."""
    here = Window.partitionBy("query_id", "node_id")
    ranked = table.withColumns({"place": F.rank().over(here.orderBy("fused")), "row": F.row_number().over(here.orderBy("fused", "parent")), "n": F.count(F.lit(1)).over(here), "best": F.min("fused").over(here)})
    ranked = ranked.withColumn("ties", F.sum((F.col("place") == 1).cast("int")).over(here))
    first = F.col("place") == 1
    return ranked.groupBy("query_id", "parent").agg(
        F.sum(F.when(first, 1 / F.col("ties")).otherwise(0.0)).alias("fractional"),
        F.sum(F.when(first, 1 / (1 + F.col("best")) / F.col("ties")).otherwise(0.0)).alias("confidence"),
        F.sum(1 / F.col("place")).alias("reciprocal"),
        F.sum((F.col("row") - 1) / F.greatest(F.col("n") - 1, F.lit(1))).alias("normalised"),
    )


def by_component(table: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, node_id, component, parent): each component of ``labels`` (query_id, node_id, component)
    takes the parent of least summed regret among those that all its nodes with evidence know, ties by
    parent; null where there is none.  A ``table`` of some parents only holds the choice to them."""
    best = F.min("fused").over(Window.partitionBy("query_id", "node_id"))
    rows = table.select("query_id", "node_id", "parent", (F.col("fused") - best).alias("regret")).join(labels, ["query_id", "node_id"])
    nodes = rows.groupBy("query_id", "component").agg(F.countDistinct("node_id").alias("nodes"))
    costs = rows.groupBy("query_id", "component", "parent").agg(F.count(F.lit(1)).alias("known"), F.round(F.sum("regret"), 9).alias("cost"))
    whole = costs.join(nodes, ["query_id", "component"]).where("known = nodes")
    chosen = whole.groupBy("query_id", "component").agg(F.min_by("parent", F.struct("cost", "parent")).alias("parent"))
    return rows.select("query_id", "node_id", "component").distinct().join(chosen, ["query_id", "component"], "left").select("query_id", "node_id", "component", "parent")


def within(table: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``table`` whose parent is in its query's set (p1, p2, p3)."""
    members = sets.select("query_id", F.explode(F.array_compact(F.array("p1", "p2", "p3"))).alias("parent"))
    return table.join(members, ["query_id", "parent"], "left_semi")
