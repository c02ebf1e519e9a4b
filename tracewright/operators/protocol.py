"""Tables that experiments are built from, and comparisons of what two methods say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_order


def thinned(edges: DataFrame, group: str, key: Column, share: float) -> DataFrame:
    """Each group's edges without its first ``share`` by hash order (rounded down)."""
    w = Window.partitionBy(group)
    placed = edges.withColumns({"place": F.row_number().over(w.orderBy(hash_order(key, salt="drop"), "b")), "n": F.count(F.lit(1)).over(w)})
    return placed.where(F.col("place") > F.floor(F.lit(share) * F.col("n"))).drop("place", "n")


def global_pair(table: DataFrame) -> DataFrame:
    """The two parents with the least total of nearest distances, no node unknown, ties by parents.  A node's
    parents are a project list, paired on (query, node) and summed before the choice."""
    other = table.select("query_id", "node_id", F.col("parent").alias("p2"), F.col("fused").alias("other"))
    pairs = table.withColumnRenamed("parent", "p1").join(other, ["query_id", "node_id"]).where("p1 < p2")
    totals = pairs.groupBy("query_id", "p1", "p2").agg(F.round(F.sum(F.least("fused", "other")), 9).alias("total"))
    best = totals.groupBy("query_id").agg(F.min(F.struct("total", "p1", "p2")).alias("best"))
    return best.select("query_id", "best.p1", "best.p2", "best.total")


def compared(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """``one`` and ``other`` of each key on either side, and whether they agree (null equals null)."""
    return a.join(b, key, "full_outer").select(*key, "one", "other", F.col("one").eqNullSafe(F.col("other")).alias("same"))


def shared_by_all(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Parents that every node of a query lists (rows are distinct by node and parent)."""
    whole = nodes.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    held = rows.groupBy("query_id", "parent").agg(F.count(F.lit(1)).alias("held"))
    return held.join(whole, "query_id").where("held = n").select("query_id", "parent")


def nested(table: DataFrame, scales: list[int]) -> DataFrame:
    """Mean best distance as the gallery grows by hash order, each scale holding the smaller ones."""
    place = F.row_number().over(Window.orderBy(hash_order(F.col("parent")), "parent"))  # one row a project
    order = table.select("parent").distinct().withColumn("place", place)
    tried = table.join(order, "parent").withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales]))).where("place <= scale")
    best = tried.groupBy("scale", "query_id", "node_id").agg(F.min("fused").alias("best"))
    return best.groupBy("scale").agg(F.count(F.lit(1)).alias("nodes"), F.avg("best").alias("mean_best"))


def clone_votes(pairs: DataFrame) -> DataFrame:
    """Parent with the most distinct methods of each node; null where several have as many."""
    support = pairs.groupBy("node_id", "parent").agg(F.countDistinct("method").alias("support"))
    best = support.groupBy("node_id", "support").agg(F.count(F.lit(1)).alias("ties"), F.max("parent").alias("one"))
    top = best.groupBy("node_id").agg(F.max(F.struct("support", "ties", "one")).alias("b"))
    return top.select("node_id", "b.support", "b.ties", F.when(F.col("b.ties") == 1, F.col("b.one")).alias("parent"))


def older(rows: DataFrame, by: str, newest: list[str], most: int) -> DataFrame:
    """The ``most`` versions before the current one, newest first."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(c) for c in newest]))
    return rows.withColumn("place", place).where((F.col("place") >= 2) & (F.col("place") <= most + 1))


def as_of(rows: DataFrame, by: str, when: str, what: str, moment: Column) -> DataFrame:
    """The last version at or before a moment, ties by id."""
    return rows.where(F.col(when) <= moment).groupBy(by).agg(F.max_by(what, F.struct(when, what)).alias(what))


def hidden(nodes: DataFrame) -> DataFrame:
    """One true parent of each query, by hash, that plays the unknown; queries without one give no row."""
    counts = nodes.where("truth is not null").groupBy("query_id", F.col("truth").alias("hidden_parent")).agg(F.count(F.lit(1)).alias("pseudo_unknown_components"))
    w = Window.partitionBy("query_id")
    place = F.row_number().over(w.orderBy(hash_order(F.concat_ws("-", "query_id", "hidden_parent"), salt="hide"), "hidden_parent"))
    return counts.withColumns({"place": place, "visible_true_parents": F.count(F.lit(1)).over(w) - 1}).where("place = 1").select("query_id", "hidden_parent", "visible_true_parents", "pseudo_unknown_components")


def restored(rows: DataFrame, hide: DataFrame) -> DataFrame:
    """Scores of the visible parents, and those of the hidden ones added back, marked."""
    key = hide.select("query_id", F.col("hidden_parent").alias("parent"))
    seen = rows.join(key, ["query_id", "parent"], "left_anti").withColumn("visible", F.lit(True))
    return seen.unionByName(rows.join(key, ["query_id", "parent"], "left_semi").withColumn("visible", F.lit(False)))


def tiled(rows: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times, numbered by ``tile``."""
    return rows.withColumn("tile", F.explode(F.sequence(F.lit(1), F.lit(times))))


def aligned(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """``a`` and ``b`` joined on the key; a key that only one side has is an error."""
    here = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), key, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return here.where(F.when(both, True).otherwise(F.raise_error(F.concat(F.lit("one side lacks "), F.concat_ws("/", *key))).cast("boolean"))).drop("_a", "_b")


def with_roles(rows: DataFrame, roles: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with the role of their key; a row whose key has none is an error."""
    joined = rows.join(roles.select(key, column), key, "left")
    return joined.withColumn(column, F.coalesce(column, F.raise_error(F.concat(F.lit("no role for "), F.col(key).cast("string"))).cast("string")))


def at_least(pool: DataFrame, by: str, k: int) -> DataFrame:
    """``pool``, or an error if a group has fewer than k rows."""
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    return pool.withColumn("_n", n).where(F.when(F.col("_n") >= k, True).otherwise(F.raise_error(F.concat(F.lit("too few in "), F.col(by).cast("string"))).cast("boolean"))).drop("_n")


def masks(rows: DataFrame, current: DataFrame) -> DataFrame:
    """hard: the content is not in the own project's current release; strict: nor is the path."""
    sha = current.select("project", "sha").distinct().withColumn("_sha", F.lit(True))
    path = current.select("project", "path").distinct().withColumn("_path", F.lit(True))
    joined = rows.join(sha, ["project", "sha"], "left").join(path, ["project", "path"], "left")
    hard = F.col("_sha").isNull()
    return joined.select("id", hard.alias("hard"), (hard & F.col("_path").isNull()).alias("strict"))


def source_files(references: DataFrame, files: DataFrame) -> DataFrame:
    """The source file of each reference (id, path) among ``files`` (path): the one that ends with its path,
    else the one of its name, else why there is none.  Files enter by every suffix, so both are equi-joins."""
    parts = F.split("path", "/")
    ends = files.distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "/"))).alias("end"))
    by_end = ends.groupBy("end").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("file"))
    name = F.substring_index("path", "/", -1)
    rows = references.select("id", "path", name.alias("name"))
    whole = by_end.select(F.col("end").alias("path"), F.col("n").alias("whole"), F.col("file").alias("whole_file"))
    short = by_end.select(F.col("end").alias("name"), F.col("n").alias("named"), F.col("file").alias("named_file"))
    joined = rows.join(whole, "path", "left").join(short, "name", "left")
    status = F.when(F.col("whole") == 1, "SUFFIX").when(F.col("whole") > 1, "AMBIGUOUS_SUFFIX").when(F.col("named") == 1, "BASENAME").when(F.col("named") > 1, "AMBIGUOUS_BASENAME").otherwise("MISSING")
    return joined.select("id", status.alias("status"), F.when(F.col("whole") == 1, F.col("whole_file")).when(F.col("whole").isNull() & (F.col("named") == 1), F.col("named_file")).alias("file"))


def chosen_tags(wanted: DataFrame, tags: DataFrame) -> DataFrame:
    """The tag of each wanted version (id, repo, version, date) among ``tags`` (repo, tag, date; normalised
    ``tag`` and ``version``): the same, else the only one that ends with it, else the last one by its date."""
    met = wanted.withColumnsRenamed({"date": "by"}).join(tags, "repo")
    same, ends = F.col("tag") == F.col("version"), F.col("tag").endswith(F.col("version"))
    last = lambda when: F.max(F.when(when, F.struct("date", "tag"))).getField("tag")
    found = met.groupBy("id").agg(last(same).alias("exact"), F.countDistinct(F.when(ends, F.col("tag"))).alias("n"), last(ends).alias("suffix"), last(F.col("date") <= F.col("by")).alias("dated"))
    suffix = F.when(F.col("n") == 1, F.col("suffix"))
    how = F.when(F.col("exact").isNotNull(), "EXACT").when(suffix.isNotNull(), "SUFFIX").when(F.col("dated").isNotNull(), "DATE").otherwise("NONE")
    return wanted.select("id").join(found, "id", "left").select("id", F.coalesce("exact", suffix, "dated").alias("tag"), how.alias("how"))


def global_sets(table: DataFrame, most: int = 3) -> DataFrame:
    """For each K up to ``most`` (three) the K parents with the least total of nearest distances, no node
    unknown, ties by parents.  A node's parents are a project list."""
    out = None
    for k in range(1, most + 1):
        rows = table.select("query_id", "node_id", F.col("parent").alias("p1"), F.col("fused").alias("d"))
        for i in range(2, k + 1):
            other = table.select("query_id", "node_id", F.col("parent").alias(f"p{i}"), F.col("fused").alias("o"))
            rows = rows.join(other, ["query_id", "node_id"]).where(F.col(f"p{i - 1}") < F.col(f"p{i}")).withColumn("d", F.least("d", "o")).drop("o")
        ps = [f"p{i}" for i in range(1, k + 1)]
        best = rows.groupBy("query_id", *ps).agg(F.round(F.sum("d"), 9).alias("total")).groupBy("query_id").agg(F.min(F.struct("total", *ps)).alias("b"))
        none = F.lit(None).cast(table.schema["parent"].dataType)
        best = best.select("query_id", F.lit(k).alias("k"), F.col("b.total").alias("total"), *[(F.col(f"b.p{i}") if i <= k else none).alias(f"p{i}") for i in (1, 2, 3)])
        out = best if out is None else out.unionByName(best)
    return out


def scenarios(parents: DataFrame, components: DataFrame, kinds: list[tuple[str, int, int]], count: int, allocation: dict[int, list[int]], seed: str = "0") -> DataFrame:
    """Query packages: of each kind (name, known parents, unknown parents) ``count`` queries; parents
    (parent, known) and their components (parent, id) are taken in hash order, components by the allocation
    of as many parents.  One row a component, its slot the place of its parent."""
    spark = parents.sparkSession
    plan = [(name, f"{name}-{i}", known, unknown, k + 1, allocation[known + unknown][k]) for name, known, unknown in kinds for i in range(count) for k in range(known + unknown)]
    plan = spark.createDataFrame(plan, "scenario string, query string, known int, unknown int, slot int, take int")
    asked = plan.select("query").distinct().join(parents)  # a project list for each query
    order = hash_order(F.concat_ws("-", "query", "parent"), seed, "parent")
    place = F.row_number().over(Window.partitionBy("query", "known").orderBy(order, "parent"))
    ranked = asked.withColumn("place", place).withColumnsRenamed({"known": "is_known"})
    wanted = F.when(F.col("slot") <= F.col("known"), F.col("slot")).otherwise(F.col("slot") - F.col("known"))
    chosen = plan.withColumns({"place": wanted, "is_known": F.col("slot") <= F.col("known")}).join(ranked, ["query", "place", "is_known"])
    drawn = chosen.join(components, "parent")
    nth = F.row_number().over(Window.partitionBy("query", "slot").orderBy(hash_order(F.concat_ws("-", "query", "id"), seed, "component"), "id"))
    return drawn.withColumn("nth", nth).where("nth <= take").select("scenario", "query", "slot", "parent", "id")


def recomposed(unknown: DataFrame, donors: DataFrame, seed: str = "0") -> DataFrame:
    """Unknown components (query_id, node_id) with sources of their own: a query's slots, in the order of
    its nodes, take its sources in hash order in turn, and of a source the donor components (source, id) in
    hash order.  (query_id, node_id, slot, source, donor)"""
    slot = F.row_number().over(Window.partitionBy("query_id").orderBy("node_id")) - 1
    slots = unknown.select("query_id", "node_id").withColumn("slot", slot)
    asked = slots.select("query_id").distinct().join(donors.select("source").distinct())  # a project list
    w = Window.partitionBy("query_id")
    ranked = asked.withColumns({"turn": F.row_number().over(w.orderBy(hash_order(F.concat_ws("-", "query_id", "source"), seed, "source"), "source")) - 1, "n": F.count(F.lit(1)).over(w)})
    dealt = slots.join(ranked, "query_id").where(F.pmod("slot", "n") == F.col("turn")).withColumn("nth", F.floor(F.col("slot") / F.col("n")) + 1)
    nth = F.row_number().over(Window.partitionBy("source").orderBy(hash_order(F.col("id"), seed, "donor"), "id"))
    return dealt.join(donors.withColumn("nth", nth), ["source", "nth"]).select("query_id", "node_id", "slot", "source", F.col("id").alias("donor"))


def corrupted(edges: DataFrame, nodes: DataFrame, share: float = 0.3, seed: str = "0") -> DataFrame:
    """(condition, query_id, node_a, node_b) under DROP30, BRIDGE and both: ``share`` of each query's edges go,
    rounded half to even, one at least; of each two parents next in order, one node each becomes an edge.
    Edges and nodes are drawn by hash order."""
    own = edges.select("query_id", F.least("node_a", "node_b").alias("node_a"), F.greatest("node_a", "node_b").alias("node_b")).distinct()
    w = Window.partitionBy("query_id")
    place = F.row_number().over(w.orderBy(hash_order(F.concat_ws("-", "query_id", "node_a", "node_b"), seed, "drop"), "node_a", "node_b"))
    gone = F.greatest(F.bround(F.count(F.lit(1)).over(w) * F.lit(share)), F.lit(1.0))
    left = own.withColumns({"place": place, "gone": gone}).where("place > gone").drop("place", "gone")
    drawn = lambda side: F.min_by("node_id", F.struct(hash_order(F.col("node_id"), seed, side), "node_id"))
    ends = nodes.where("truth is not null").groupBy("query_id", "truth").agg(drawn("left").alias("a"), drawn("right").alias("other"))
    ends = ends.withColumn("b", F.lead("other").over(w.orderBy("truth"))).where("b is not null")
    bridges = ends.select("query_id", F.least("a", "b").alias("node_a"), F.greatest("a", "b").alias("node_b"))
    named = lambda name, rows: rows.select(F.lit(name).alias("condition"), "query_id", "node_a", "node_b")
    return named("DROP30", left).unionByName(named("BRIDGE", own.unionByName(bridges).distinct())).unionByName(named("DROP30_BRIDGE", left.unionByName(bridges).distinct()))


def frozen(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``files`` (name, sha) as the manifest (name, sha) has them; a file that is missing, new or changed is
    an error."""
    both = files.select("name", F.col("sha").alias("found")).join(manifest.select("name", F.col("sha").alias("told")), "name", "full_outer")
    wrong = F.raise_error(F.concat(F.lit("not as frozen: "), F.col("name").cast("string"))).cast("string")
    return both.select("name", F.when(F.col("found") == F.col("told"), F.col("found")).otherwise(wrong).alias("sha"))


def audited(reported: DataFrame, computed: DataFrame, key: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Reported against recomputed values (key, value): MATCH within the tolerance (null matches null),
    DIFFERENT, UNREPORTED or UNSUPPORTED."""
    r = reported.select(*key, F.col("value").alias("reported"), F.lit(True).alias("_r"))
    c = computed.select(*key, F.col("value").alias("computed"), F.lit(True).alias("_c"))
    near = F.col("reported").eqNullSafe(F.col("computed")) | (F.abs(F.col("reported") - F.col("computed")) <= tolerance)
    status = F.when(F.col("_r").isNull(), "UNREPORTED").when(F.col("_c").isNull(), "UNSUPPORTED").when(near, "MATCH").otherwise("DIFFERENT")
    return r.join(c, key, "full_outer").select(*key, "reported", "computed", status.alias("status"))
