"""Candidate pools by exact scores, and shortlists by multi-band locality-sensitive hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a band by mode (fixed values); narrower bands cut from the same low end, so shortlists nest.
BAND_BITS = {"FAST": 32, "BALANCED": 16, "HIGH_RECALL": 8}


def parent_scores(costs: DataFrame, best: int = 3) -> DataFrame:
    """(query_id, parent, score): the mean of the cheapest component costs."""
    rank = F.row_number().over(Window.partitionBy("query_id", "parent").orderBy("cost", "node_id"))
    return costs.select("query_id", "node_id", "parent", "cost").withColumn("place", rank).where(F.col("place") <= best).groupBy("query_id", "parent").agg(F.avg("cost").alias("score"))


def pool(scores: DataFrame, size: int) -> DataFrame:
    """The parents of the lowest scores of each query, ranked; ties by parent."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9), "parent"))
    return scores.withColumn("rank", place).where(F.col("rank") <= size)


def bands(rows: DataFrame, words: list[str], mode: str) -> DataFrame:
    """``rows`` exploded into (word, band, value): all bands of all 32-bit words."""
    width = BAND_BITS[mode]
    parts = [F.struct(F.lit(w).alias("word"), F.lit(k).alias("band"), F.shiftrightunsigned(F.col(w), k * width).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for w in words for k in range(32 // width)]
    return rows.select("*", F.inline(F.array(*parts)))


def shortlist(nodes: DataFrame, gallery: DataFrame, words: list[str], mode: str) -> DataFrame:
    """(query_id, parent) that share a band; the index holds each (band, value, parent) once."""
    index = bands(gallery.select("parent", *words), words, mode).select("word", "band", "value", "parent").distinct()
    probe = bands(nodes.select("query_id", *words), words, mode).select("word", "band", "value", "query_id").distinct()
    return probe.join(index, ["word", "band", "value"]).select("query_id", "parent").distinct()


def fidelity(exact: DataFrame, found: DataFrame) -> DataFrame:
    """Of each query: how many of the exact pool the shortlist holds, its size, and whether all."""
    both = exact.select("query_id", "parent").join(found.withColumn("hit", F.lit(1)), ["query_id", "parent"], "left")
    share = both.groupBy("query_id").agg(F.count(F.lit(1)).alias("pool"), F.coalesce(F.sum("hit"), F.lit(0)).alias("held"))
    size = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("shortlist"))
    return share.join(size, "query_id", "left").select("query_id", "pool", "held", F.coalesce("shortlist", F.lit(0)).alias("shortlist"), (F.col("held") == F.col("pool")).alias("identical"))
