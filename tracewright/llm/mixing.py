"""Mixing sources to target weights by subset-sum budget fitting.

Sources share a budget in proportion to their weights, none above a multiple of its own size.  Within a
source every document is first taken a whole number of times; a subset is taken once more, so that its
words come to the rest of the budget.  For that, documents are counted by exact length; each length
gives its share of all but the last ``WIDTH / 2`` words, whole documents only, and what is then left is
fitted by bounded-knapsack dynamic programming over the lengths' remaining counts.  Which documents of a length are taken follows the order of a seeded hash of their ids and texts,
found by counts in hash buckets, so no length is ever gathered in one task.  Sources are numbered and
their targets found in passes over the table of sources; none of it comes to the driver.

* a null text, or one without a word, has size 0 and is taken 0 times; a null source is a source;
* rows that repeat doc_id, source and text share their fate; a null doc_id is hashed as one;
* a source of one document takes the nearest number of whole copies; empty table: no rows;
* columns beside doc_id, text and source are not read, whatever their names; ``repeat_to_mix`` keeps them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2
#: Budget that the dynamic programme covers exactly, lengths that it deals where only long documents are
#: left, and documents that a hash bucket holds on average.
WIDTH, LARGEST, BUCKET = 1 << 16, 512, 1000
SEED = 20


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(key, words, target) of ``sources`` (key, words): each source's words by weight, at most ``most``
    times its size, the excess reshared by weight.  Weights repeat along the order of the keys."""
    # numbered in that order: ranges of keys, their sizes before them, and the place within the range
    ranged = sources.repartitionByRange("key").withColumn("range", F.spark_partition_id())
    ranged = store.written(ranged, "mix-ranges")
    before, start = 0, {}
    for r in ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect():  # a row a partition
        start[r["range"]] = before
        before += r["n"]
    offset = F.element_at(F.create_map(*[F.lit(x) for k, v in start.items() for x in (k, v)]), F.col("range")) if start else F.lit(0)
    place = offset + F.row_number().over(Window.partitionBy("range").orderBy("key")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    weighed = store.written(ranged.select("key", "words", weight.alias("weight")), "mix-weights")
    # words a unit of weight: sources that would pass their most at that level leave the rest to the others,
    # whose level rises; a source that is full stays full
    whole = weighed.agg(F.sum("words").alias("w")).first()["w"] or 0
    full = lambda level: F.col("weight") * F.lit(level) > F.col("words") * F.lit(float(most))
    level, known = 0.0, -1
    while True:
        over = full(level) if known >= 0 else F.lit(False)
        r = weighed.agg(F.sum(F.when(~over, F.col("weight"))).alias("open"), F.sum(F.when(over, F.col("words"))).alias("words"), F.sum(over.cast("long")).alias("n")).first()
        if not r["open"] or r["n"] == known:
            break
        known, level = r["n"], (share * whole - most * (r["words"] or 0)) / r["open"]
    target = F.least(F.col("weight") * F.lit(level), F.col("words") * F.lit(float(most)))
    return weighed.select("key", "words", target.alias("target"))


def _pair(lengths: np.ndarray, counts: np.ndarray, left: int) -> list[int]:
    """One or two documents (or none) whose words come nearest to ``left``, as indices."""
    best, error = [], left
    own = np.flatnonzero((counts > 0) & (lengths <= 2 * left))
    own = own[np.argsort(lengths[own], kind="stable")]
    words = lengths[own]
    if not len(own):
        return best
    k = int(np.abs(words - left).argmin())
    if abs(int(words[k]) - left) < error:
        best, error = [int(own[k])], abs(int(words[k]) - left)
    at = np.searchsorted(words, left - words)
    for shift in (-2, -1, 0, 1):
        other = np.clip(at + shift, 0, len(own) - 1)
        off = np.abs(words + words[other] - left)
        off[(other == np.arange(len(own))) & (counts[own] < 2)] = left
        k = int(off.argmin())
        if off[k] < error:
            best, error = [int(own[k]), int(own[other[k]])], int(off[k])
    return best


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come to ``budget``, or near it."""
    total = int((lengths * counts).sum())
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * max(0, budget - WIDTH // 2) // total for c in counts], np.int64)
    left = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= WIDTH:
            break
        more = min(int(counts[i] - take[i]), (left - WIDTH // 2) // int(lengths[i]))
        if more > 0:
            take[i] += more
            left -= more * int(lengths[i])
    if left <= WIDTH:
        return take + _knapsack(lengths, counts - take, left)
    # each document that is left has more than left / 2 words: two at most are of use; or the largest
    # lengths are dealt anew beside the others
    more = np.bincount(np.array(_pair(lengths, counts - take, left), np.int64), minlength=len(lengths))
    anew = np.zeros(len(lengths), bool)
    anew[np.argsort(-lengths, kind="stable")[:LARGEST]] = True
    rest = np.where(anew, 0, take)
    rest += _knapsack(lengths, np.where(anew, counts, 0), budget - int((lengths * rest).sum()))
    return min(take + more, rest, key=lambda x: abs(int((lengths * x).sum()) - budget))


def _knapsack(lengths: np.ndarray, counts: np.ndarray, left: int) -> np.ndarray:
    """How many of each length come nearest to ``left`` words.  Counts are split into powers of two.  Sums
    up to twice ``left`` lie in 2 * WIDTH + 1 buckets (one each, if there are no more sums), of which each
    keeps the first sum that is met and the item that met it."""
    items = []
    for i in np.argsort(lengths, kind="stable"):
        free, part = min(int(counts[i]), 2 * left // int(lengths[i])), 1
        while free > 0:
            items.append((i, min(part, free), min(part, free) * int(lengths[i])))
            free -= part
            part *= 2
    width = min(2 * left, 2 * WIDTH) + 1
    place = lambda x: x * width // (2 * left + 1)
    by, met = np.full(width, -1, np.int32), np.full(width, -1, np.int64)
    met[0] = 0
    for k, (_, _, words) in enumerate(items):
        sums = met[met >= 0] + words
        sums = sums[sums <= 2 * left]
        sums = sums[met[place(sums)] < 0]
        met[place(sums)] = sums
        by[place(sums)] = k
        if met[place(left)] == left:
            break
    met = met[met >= 0]
    best, take = int(met[np.argmin(np.abs(met - left))]), np.zeros(len(lengths), np.int64)
    while best:
        i, many, words = items[by[place(best)]]
        take[i] += many
        best -= words
    return take


def _planned(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size").reset_index(drop=True)
    whole, target = int(group["source_size"][0]), float(group["target"][0])
    times = min(int(target // whole), MOST) if whole else 0
    words = group["size"].to_numpy(np.int64)
    take = np.zeros(len(group), np.int64)
    real = words > 0
    take[real] = fit(words[real], group["documents"].to_numpy(np.int64)[real], math.floor(target - times * whole + 0.5))
    if times >= MOST:
        take[:] = 0
    return group.assign(times=times, take=take)[["key", "size", "documents", "source_size", "target", "times", "take"]]


def _described(docs: DataFrame, seed: int, key: str = "key", size: str = "size", order: str = "order") -> DataFrame:
    """docs with its key (the source), size and order in columns of these names."""
    return docs.withColumns(
        {
            key: F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("2")),
            size: word_count(F.col("text").cast("string")),
            order: F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string")),
        }
    )


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """(key, size, source_size, target, times, cut): documents of that source and size are taken
    ``times``, and once more if their order is at most ``cut``."""
    sized = store.written(_described(docs.select("doc_id", "text", "source"), seed).select("key", "size", "order"), "mix-sizes")
    counted = store.written(sized.groupBy("key", "size").agg(F.count(F.lit(1)).alias("documents")), "mix-counts")
    totals = targets(counted.groupBy("key").agg(F.sum(F.col("size") * F.col("documents")).alias("words")), weights, share).withColumnRenamed("words", "source_size")
    schema = "key string, size long, documents long, source_size long, target double, times int, take long"
    planned = store.written(counted.transform(store.merged, totals, "key").groupBy("key").applyInPandas(_planned, schema), "mix-plan")
    part = planned.where("take > 0 and take < documents").select("key", "size", "take", F.ceil(F.col("documents") / BUCKET).alias("buckets"))
    bucket = F.floor((F.col("order") / F.lit(float(2**64)) + 0.5) * F.col("buckets")).cast("long")
    dealt = sized.transform(store.merged, part, ["key", "size"]).withColumn("bucket", bucket).select("key", "size", "bucket", "take", "order")
    held = dealt.groupBy("key", "size", "bucket", "take").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("key", "size").orderBy("bucket"))
    edge = store.written(held.withColumn("upto", upto).where("upto >= take and upto - n < take").select("key", "size", "bucket", (F.col("take") - F.col("upto") + F.col("n")).alias("nth")), "mix-edges")
    same = dealt.drop("take").transform(store.merged, edge, ["key", "size", "bucket"]).groupBy("key", "size", "bucket", "nth", "order").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("key", "size", "bucket").orderBy("order"))
    cut = same.withColumn("upto", upto).where("upto >= nth and upto - n < nth").select("key", "size", F.col("order").alias("at"))
    end = F.lit(2**63 - 1)
    return store.written(
        planned.transform(store.merged, cut, ["key", "size"], "left").select("key", "size", "source_size", "target", "times", F.when(F.col("take") == 0, F.lit(None)).when(F.col("take") == F.col("documents"), end).otherwise(F.col("at")).alias("cut")),
        "mix-cuts",
    )


def _times(order: str = "order", times: str = "times", cut: str = "cut") -> Column:
    return F.col(times) + F.coalesce((F.col(order) <= F.col(cut)).cast("int"), F.lit(0))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``docs`` (doc_id, text, source)."""
    store.prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    joined = _described(docs, seed).drop("text", "source").transform(store.merged, plan(docs, weights, share, seed), ["key", "size"])
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def repeat_to_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (0 to 2 times), all columns kept, whatever
    their names.  Null texts and texts without a word are never taken; rows that repeat doc_id, source and
    text are taken alike; the order among equal lengths is the seeded hash's."""
    store.prepare(docs.sparkSession)
    plans = plan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source"), weights, share, seed)
    key, size, order, times, cut, copy = store.unused(docs, "key", "size", "order", "times", "cut", "copy")
    plans = plans.select(F.col("key").alias(key), F.col("size").alias(size), F.col("times").alias(times), F.col("cut").alias(cut))
    joined = _described(docs, seed, key, size, order).transform(store.merged, plans, [key, size])
    return joined.where(F.col(size) > 0).withColumn(copy, F.explode(F.array_repeat(F.lit(0), _times(order, times, cut)))).select(*docs.columns)
