"""Signatures against a gallery: distances, their minima by parent, regret, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import histogram_distance
from ..params import EPSILON, MISSING, Method


def sign_word(vector: Column, at: int) -> Column:
    """32 sign bits of a vector from position ``at``, lowest first."""
    bits = F.transform(F.slice(vector, at + 1, 32), lambda x, i: F.when(x >= 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a + x)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _minima(compared: DataFrame, words: dict[str, int]) -> DataFrame:
    near = compared.groupBy("query_id", "node_id", "parent").agg(*[F.min(hamming(F.col(w), F.col(f"g_{w}"))).alias(w) for w in words])
    return near.select("query_id", "node_id", "parent", *[F.coalesce(F.col(w) / bits, F.lit(MISSING)).alias(f"d_{w}") for w, bits in words.items()])


def parent_minima(nodes: DataFrame, gallery: DataFrame, words: dict[str, int], blocks: int | None = None) -> DataFrame:
    """(query_id, node_id, parent, one distance for each representation): the least distance of a node to
    each parent's components, missing ones 1.  ``words`` maps a representation's column to its bits.

    Every node meets the whole gallery, so every parent has its row.  The product is dealt in blocks of the
    gallery (by default a quarter of the shuffle partitions) by an equi-join on the block, so it is a hash
    join with map-side minima at any size; only nodes are repeated, once for each block.
    """
    if blocks is None:
        blocks = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    g = gallery.select("parent", *[F.col(w).alias(f"g_{w}") for w in words], F.pmod(F.xxhash64("parent", *words), F.lit(blocks)).alias("block"))
    n = nodes.select("query_id", "node_id", *words, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    return _minima(n.join(g, "block"), words)


def listed_minima(nodes: DataFrame, gallery: DataFrame, listed: DataFrame, words: dict[str, int]) -> DataFrame:
    """``parent_minima`` of the parents that ``listed`` (query_id, parent) has for a node's query, and of no
    others: what is not listed is never compared."""
    g = gallery.select("parent", *[F.col(w).alias(f"g_{w}") for w in words])
    n = nodes.select("query_id", "node_id", *words)
    return _minima(n.join(listed.select("query_id", "parent").distinct(), "query_id").join(g, "parent"), words)


def modal_minima(nodes: DataFrame, gallery: DataFrame, representations: dict[str, dict[str, list[str]]], histograms: dict[str, str]) -> DataFrame:
    """(query_id, node_id, parent, distance) by modality: the mean over a modality's representations (lists
    of 32-bit words, and a histogram column where ``histograms`` names one) of the least distance to each
    parent's components of the same modality, dealt in blocks of the gallery; a parent without such
    components has no row."""
    out, blocks = None, max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    for modality, words in representations.items():
        own, other = nodes.where(F.col("modality") == modality), gallery.where(F.col("modality") == modality)
        columns = sorted({c for cs in words.values() for c in cs} | ({histograms[modality]} if modality in histograms else set()))
        g = other.select("parent", *[F.col(c).alias(f"g_{c}") for c in columns], F.pmod(F.xxhash64("parent", *columns), F.lit(blocks)).alias("block"))
        met = own.select("query_id", "node_id", *columns, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")).join(g, "block")
        least = {name: F.min(sum((hamming(F.col(c), F.col(f"g_{c}")) for c in cs), F.lit(0)) / (32 * len(cs))) for name, cs in words.items()}
        if modality in histograms:
            least["histogram"] = F.min(histogram_distance(F.col(histograms[modality]), F.col(f"g_{histograms[modality]}")))
        near = met.groupBy("query_id", "node_id", "parent").agg(*[v.alias(k) for k, v in least.items()])
        rows = near.select("query_id", "node_id", "parent", (sum((F.coalesce(F.col(k), F.lit(MISSING)) for k in least), F.lit(0.0)) / len(least)).alias("distance"))
        out = rows if out is None else out.unionByName(rows)
    return out


def fused(minima: DataFrame, columns: list[str]) -> DataFrame:
    """``minima`` with the mean over the representations there are, in single precision, and the mean regret
    against the best visible parent."""
    here = Window.partitionBy("query_id", "node_id")
    mean = lambda cs: sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0)) / sum((c.isNotNull().cast("int") for c in cs), F.lit(0))
    values = [F.col(c) for c in columns]
    return minima.withColumns({"fused": mean(values).cast("float").cast("double"), "regret": mean([v - F.min(v).over(here) for v in values])})


def eligible(distance: Column, threshold: float) -> Column:
    return F.abs(distance) <= EPSILON if threshold == 0 else distance <= threshold + EPSILON


def cost(distance: Column, regret: Column, threshold: float, alpha: float = 0.75) -> Column:
    part = F.when(F.abs(distance) <= EPSILON, 0.0).otherwise(1.0) if threshold == 0 else F.least(distance / threshold, F.lit(1.0))
    return alpha * part + (1 - alpha) * F.least(F.greatest(regret, F.lit(0.0)), F.lit(1.0))


def scored(minima: DataFrame, columns: list[str], method: Method) -> DataFrame:
    table = fused(minima, columns)
    return table.withColumns({"eligible": eligible(F.col("fused"), method.threshold), "cost": cost(F.col("fused"), F.col("regret"), method.threshold, method.alpha)})


def fusion_variants(minima: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and median of min-max regrets, and mean rank, over the representations."""
    here = Window.partitionBy("query_id", "node_id")
    out = {}
    for c in columns:
        low, high = F.min(c).over(here), F.max(c).over(here)
        out[f"r_{c}"] = F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.0)
        out[f"k_{c}"] = F.rank().over(here.orderBy(c))
    wide = minima.withColumns(out)
    regrets, ranks = [F.col(f"r_{c}") for c in columns], [F.col(f"k_{c}") for c in columns]
    middle = F.array_sort(F.array(*regrets))
    n = len(columns)
    return wide.select("query_id", "node_id", "parent", (sum(regrets, F.lit(0.0)) / n).alias("mean_regret"), ((middle[(n - 1) // 2] + middle[n // 2]) / 2).alias("median_regret"), (sum(ranks, F.lit(0)) / n).alias("mean_rank"))


def open_set_features(table: DataFrame) -> DataFrame:
    """Best, second and margin of each node, by (distance, regret, parent)."""
    order = Window.partitionBy("query_id", "node_id").orderBy("fused", "regret", "parent")
    ranked = table.withColumn("place", F.row_number().over(order)).where("place <= 2")
    at = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    out = ranked.groupBy("query_id", "node_id").agg(at(1, "parent").alias("best_parent"), at(1, "fused").alias("best"), at(2, "fused").alias("second"))
    return out.withColumn("margin", F.coalesce(F.col("second") - F.col("best"), F.lit(0.0)))


def second_distinct(table: DataFrame) -> DataFrame:
    """The best distance, how many parents tie at it, and the margin to the next distinct distance."""
    place = F.dense_rank().over(Window.partitionBy("query_id", "node_id").orderBy("fused"))
    near = table.withColumn("place", place).where("place <= 2").groupBy("query_id", "node_id")
    out = near.agg(F.min("fused").alias("best"), F.sum((F.col("place") == 1).cast("long")).alias("ties"), F.max(F.when(F.col("place") == 2, F.col("fused"))).alias("second"))
    return out.withColumn("margin", F.col("second") - F.col("best"))
