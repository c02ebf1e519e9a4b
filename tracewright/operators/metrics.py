"""Outcome metrics: confusion, parent sets, rankings, percentiles, localisation of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def unknown_confusion(pairs: DataFrame, *by: str) -> DataFrame:
    """``pairs`` (truth, predicted; null is UNKNOWN): confusion of UNKNOWN and both classes' F1."""
    t, p = F.col("truth").isNull(), F.col("predicted").isNull()
    n = pairs.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"), F.avg(F.col("truth").eqNullSafe(F.col("predicted")).cast("double")).alias("accuracy"))
    n = n.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    known = f1(ratio(F.col("tn"), F.col("tn") + F.col("fn")), ratio(F.col("tn"), F.col("tn") + F.col("fp")))
    n = n.withColumns({"unknown_f1": f1(F.col("precision"), F.col("recall")), "known_f1": known})
    return n.withColumn("macro_f1", (F.col("unknown_f1") + F.col("known_f1")) / 2)


def set_metrics(pairs: DataFrame, empty: str = "zero") -> DataFrame:
    """Per query: precision, recall, F1, exactness of the parent sets, and K with UNKNOWN as one label.

    ``empty``: F1 of two empty sets; 'zero', or 'one' as where several unknown sources are scored.
    """
    g = pairs.groupBy("query_id").agg(
        F.collect_set("truth").alias("true_set"),
        F.collect_set("predicted").alias("found_set"),
        F.max(F.col("truth").isNull().cast("int")).alias("tu"),
        F.max(F.col("predicted").isNull().cast("int")).alias("pu"),
    )
    both, t, p = F.size(F.array_intersect("true_set", "found_set")), F.size("true_set"), F.size("found_set")
    blank = (t == 0) & (p == 0)
    g = g.withColumns({"precision": ratio(both, p), "recall": ratio(both, t)})
    value = f1(F.col("precision"), F.col("recall"))
    return g.select(
        "query_id",
        "precision",
        "recall",
        (F.when(blank, 1.0).otherwise(value) if empty == "one" else value).alias("f1"),
        ((both == t) & (both == p)).alias("exact"),
        (t + F.col("tu")).alias("k_true"),
        (p + F.col("pu")).alias("k_found"),
    )


def by_levels(rows: DataFrame, value: str, levels: list[list[str]]) -> DataFrame:
    """Mean and count of a value at several groupings in one pass."""
    names = sorted({c for level in levels for c in level})
    return rows.groupingSets([[F.col(c) for c in level] for level in levels], *[F.col(c) for c in names]).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def recall_at(table: DataFrame, truth: DataFrame, at=(1, 3, 5)) -> DataFrame:
    """Recall at several ranks, mean reciprocal rank and tie rate; a node's rank is one more than the
    parents strictly nearer than the true one."""
    true = table.join(truth, ["query_id", "node_id"]).where("parent = truth").select("query_id", "node_id", F.col("fused").alias("own"))
    rank = table.join(true, ["query_id", "node_id"]).groupBy("query_id", "node_id").agg((F.count_if(F.col("fused") < F.col("own")) + 1).alias("rank"), F.count_if(F.col("fused") == F.col("own")).alias("ties"))
    return rank.agg(*[F.avg((F.col("rank") <= k).cast("double")).alias(f"recall_{k}") for k in at], F.avg(1 / F.col("rank")).alias("mrr"), F.avg((F.col("ties") > 1).cast("double")).alias("tie_rate"), F.count(F.lit(1)).alias("nodes"))


def localised(pairs: DataFrame, pool: DataFrame, sets: DataFrame) -> DataFrame:
    """Which stage lost each wrong node: UNKNOWN, RETRIEVAL, SELECTION or ASSIGNMENT."""
    inside = pool.select("query_id", F.col("parent").alias("truth"), F.lit(True).alias("pooled"))
    rows = pairs.join(inside, ["query_id", "truth"], "left").join(sets.select("query_id", "p1", "p2", "p3"), "query_id", "left")
    chosen = F.coalesce((F.col("truth") == F.col("p1")) | (F.col("truth") == F.col("p2")) | (F.col("truth") == F.col("p3")), F.lit(False))
    stage = F.when(F.col("truth").isNull(), "UNKNOWN").when(F.col("pooled").isNull(), "RETRIEVAL").when(~chosen, "SELECTION").otherwise("ASSIGNMENT")
    return rows.where(~F.col("truth").eqNullSafe(F.col("predicted"))).select("query_id", "node_id", stage.alias("stage"))


def threshold_sweep(rows: DataFrame) -> DataFrame:
    """``rows`` (distance, known): confusion of UNKNOWN at each distinct threshold, midpoints included, in
    one sort over the distinct distances."""
    from pyspark.sql import Window

    counts = rows.groupBy("distance").agg(F.count_if("known").alias("k"), F.count_if(~F.col("known")).alias("u"))
    order = Window.orderBy("distance")  # over distinct distances only
    upto = counts.withColumns({"ka": F.sum("k").over(order), "ua": F.sum("u").over(order), "next": F.lead("distance").over(order), "kt": F.sum("k").over(Window.partitionBy()), "ut": F.sum("u").over(Window.partitionBy())})
    points = upto.select(F.explode(F.array_compact(F.array("distance", (F.col("distance") + F.col("next")) / 2))).alias("threshold"), "ka", "ua", "kt", "ut")
    tp, fp = F.col("ut") - F.col("ua"), F.col("kt") - F.col("ka")
    unknown = f1(ratio(tp, tp + fp), ratio(tp, F.col("ut")))
    known = f1(ratio(F.col("ka"), F.col("ka") + F.col("ua")), ratio(F.col("ka"), F.col("kt")))
    return points.select("threshold", tp.alias("tp"), fp.alias("fp"), F.round((unknown + known) / 2, 9).alias("macro_f1"), F.round(unknown, 9).alias("unknown_f1"))


def taxonomy(pairs: DataFrame, pool: DataFrame) -> DataFrame:
    """Each node's error type and the stage that fails: (truth, predicted; null is UNKNOWN) against the
    query's pool of parents."""
    held = pool.groupBy("query_id").agg(F.collect_set("parent").alias("pool"))
    rows = pairs.join(held, "query_id", "left")
    t, p = F.col("truth"), F.col("predicted")
    inside = F.coalesce(F.array_contains("pool", t), F.lit(False))
    kind = F.when(t.eqNullSafe(p), "CORRECT").when(t.isNull(), "UNKNOWN_TO_KNOWN").when(p.isNull(), "KNOWN_TO_UNKNOWN").otherwise("WRONG_KNOWN_PARENT")
    stage = F.when(t.eqNullSafe(p), "NONE").when(t.isNotNull() & ~inside, "RETRIEVAL").otherwise("RECONSTRUCTION")
    return rows.select("query_id", "node_id", kind.alias("error_type"), stage.alias("failure_stage"), F.when(t.isNotNull(), inside).alias("in_pool"))


def three_truths(pairs: DataFrame) -> DataFrame:
    """Per query of (truth, predicted; null is UNKNOWN, ``source`` the real source of each node): F1 and
    exactness against the known parents and UNKNOWN as one label (collapsed), against the known parents
    alone (registered), and whether the number found is that of UNKNOWN as one and that of all sources."""
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN"))
    g = pairs.groupBy("query_id").agg(F.collect_set(label("truth")).alias("ct"), F.collect_set(label("predicted")).alias("cp"), F.collect_set("truth").alias("rt"), F.collect_set("predicted").alias("rp"), F.countDistinct("source").alias("sources"))
    def scores(t, p):
        both, nt, np_ = F.size(F.array_intersect(t, p)), F.size(t), F.size(p)
        return F.when((nt == 0) & (np_ == 0), 1.0).otherwise(f1(ratio(both, np_), ratio(both, nt))), (both == nt) & (both == np_)
    cf, ce = scores("ct", "cp")
    rf, re_ = scores("rt", "rp")
    return g.select("query_id", cf.alias("collapsed_f1"), ce.alias("collapsed_exact"), rf.alias("registered_f1"), re_.alias("registered_exact"), (F.size("cp") == F.size("ct")).alias("collapsed_k"), (F.size("cp") == F.col("sources")).alias("actual_k"))


def usage(rows: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """How often each label is used, those never used with 0."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("used"))
    return labels.select(key).distinct().join(counted, key, "left").select(key, F.coalesce("used", F.lit(0)).alias("used"))


def kept_if_better(scores: DataFrame, gain: float = 1e-12) -> DataFrame:
    """``scores`` (one, other) with their difference and the decision to keep the other method."""
    delta = F.col("other") - F.col("one")
    return scores.withColumns({"delta": delta, "decision": F.when(delta > gain, "KEEP").otherwise("REJECT")})
