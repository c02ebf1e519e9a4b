"""Resampling and sampling by hash order: the same rows on every engine and every run."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sha import first_words
from ..functions.text import hash_order, word32


#: Replicates of a task, and draws hashed at once (27 arrays of them stay in a core's cache).
REPLICATES_A_TASK, DRAWS_AT_ONCE = 64, 16384


_TYPES = {"stratum": pa.string(), "part": pa.int32(), "number": pa.int32(), "numbers": pa.binary(), "known": pa.binary()}


def _importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where they share the driver's folders."""
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "")  # ends in a slash: llm/store.py has an entry of its own
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)


def _packed(batches):
    """Rows in order to arrays: of each batch, the values of each stratum, and where they are known."""
    part = TaskContext.get().partitionId()
    for number, batch in enumerate(batches):
        strata = batch.column(0).dictionary_encode()
        code, values = np.asarray(strata.indices), batch.column(1)
        known, numbers = np.asarray(pc.is_valid(values)), np.asarray(pc.fill_null(values, 0.0), np.float64)
        rows = [{"stratum": name, "part": part, "number": number, "numbers": numbers[code == k].tobytes(), "known": known[code == k].astype(np.uint8).tobytes()} for k, name in enumerate(strata.dictionary.to_pylist())]
        yield pa.RecordBatch.from_pylist(rows, pa.schema(_TYPES))


def _decimals(begin: int, end: int):
    """(first, last + 1) of the numbers of begin to end, by their number of digits."""
    while begin < end:
        upto = min(end, 10 ** len(str(begin)))
        yield begin, upto
        begin = upto


def _digits(numbers: np.ndarray) -> list:
    """The ASCII digits of numbers of one length, the first digit first; of a single number as numbers."""
    if len(numbers) == 1:
        return list(str(numbers[0]).encode())
    return [(numbers // 10**k % 10 + 48).astype(np.uint32) for k in reversed(range(len(str(numbers[0]))))]


def _pieces(low: int, high: int, replicates: int):
    """(first, last + 1, replicates at once) of the slots from low to high: as many draws at once as fit."""
    while high - low >= DRAWS_AT_ONCE:
        yield low, low + DRAWS_AT_ONCE, 1
        low += DRAWS_AT_ONCE
    if low < high:
        size = lambda k: -(-(high - low) // k)
        k = min(range(1, 9), key=lambda k: k * -(-replicates // (DRAWS_AT_ONCE // size(k))))
        for at in range(low, high, size(k)):
            yield at, min(at + size(k), high), DRAWS_AT_ONCE // size(k)


def _drawn_slots(head: bytes, begin: int, end: int, n: int):
    """(replicates, their draws of n slots, a row a replicate), for the replicates from begin to end, in pieces."""
    for low, high in _decimals(0, n):
        for at, upto, rows in _pieces(low, high, end - begin):
            slots, each = _digits(np.arange(at, upto)), upto - at
            for first, last in _decimals(begin, end):
                for r in range(first, last, rows):
                    replicates = np.arange(r, min(r + rows, last))
                    names = [x if isinstance(x, int) else np.repeat(x, each) for x in _digits(replicates)]
                    tails = [x if isinstance(x, int) or len(replicates) == 1 else np.tile(x, len(replicates)) for x in slots]
                    words = first_words([*head, *names, ord("|"), *tails], len(replicates) * each)
                    words -= words // np.uint32(n) * np.uint32(n)
                    yield replicates, words.reshape(-1, each)


def _means(seed: str, replicates: int):
    """Means of a task's replicates over its copy of the arrays."""

    def run(batches):
        held: dict = {}
        for batch in batches:
            for task, stratum, part, number, numbers, known in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(task, {}).setdefault(stratum, []).append((part, number, numbers, known))
        for task, strata in held.items():
            begin, end = task * REPLICATES_A_TASK, min((task + 1) * REPLICATES_A_TASK, replicates)
            total, units = np.zeros(end - begin), np.zeros(end - begin, np.int64)
            for stratum in sorted(strata):
                parts = sorted(strata[stratum])
                numbers = np.frombuffer(b"".join(x[2] for x in parts), np.float64)
                known = np.frombuffer(b"".join(x[3] for x in parts), np.uint8)
                whole = known.all()
                for drawn, slots in _drawn_slots(f"{seed}|{stratum}|".encode(), begin, end, len(numbers)):
                    total[drawn - begin] += numbers.take(slots).sum(axis=1)
                    units[drawn - begin] += slots.shape[1] if whole else known.take(slots).sum(axis=1, dtype=np.int64)
            means = [float(t / u) if u else None for t, u in zip(total, units)]
            yield pa.RecordBatch.from_arrays([pa.array(range(begin, end), pa.int64()), pa.array(means, pa.float64())], names=["replicate", "mean"])

    return run


#: What ReplicateMeans is called in a session.
_JVM_MEANS = "tracewright_replicate_means"


def _in_jvm(spark: SparkSession) -> bool:
    """Whether the session has java/ReplicateMeans.java, whose jar it takes at the first bootstrap; executors get it
    from the driver.  A session that takes no jar draws in Python workers, to the same result."""
    if not spark.catalog.functionExists(_JVM_MEANS):
        jar = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "java", "resample.jar")
        try:
            spark.sql(f"ADD JAR '{jar}'")
            spark.udf.registerJavaFunction(_JVM_MEANS, "tracewright.ReplicateMeans", "array<double>")
        except (PySparkException, Py4JError):
            return False
    return True


def bootstrap(stats: DataFrame, stratum: str, value: str, replicates: int, seed: str = "0") -> DataFrame:
    """(replicate, mean): every stratum drawn with replacement as often as it has rows.  ``stats`` holds one
    row of sufficient statistics a unit.  A draw is the first 32 bits of the SHA-256 of seed, stratum, replicate
    and slot, modulo the stratum's rows.  Every task has the values as arrays (8 bytes a unit, and one that tells
    whether it is known) and draws from them for its own replicates: no draw is a row, none is shuffled."""
    spark = stats.sparkSession
    _importable(spark)
    # a null stratum has no name to draw by, and meets nothing
    units = stats.select(F.col(stratum).cast("string").alias("stratum"), "query_id", F.col(value).cast("double").alias("value")).where("stratum is not null")
    ordered = units.repartitionByRange("stratum", "query_id", "value").sortWithinPartitions("stratum", "query_id", "value").select("stratum", "value")
    packed = ordered.mapInArrow(_packed, "stratum string, part int, number int, numbers binary, known binary")
    tasks = max(1, -(-replicates // REPLICATES_A_TASK))
    copies = packed.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "*").repartitionById(tasks, F.col("task"))
    if not _in_jvm(spark):
        return copies.mapInArrow(_means(seed, replicates), "replicate long, mean double")
    # a task's rows are in its partition already, so this is no shuffle
    held = copies.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("stratum", "part", "number", "numbers", "known"))).alias("parts"))
    begin = F.col("task") * REPLICATES_A_TASK
    means = F.call_function(_JVM_MEANS, F.lit(seed), "parts", begin, F.least(begin + REPLICATES_A_TASK, F.lit(replicates)))
    return held.select("task", F.posexplode(means).alias("k", "mean")).select((begin + F.col("k")).cast("long").alias("replicate"), "mean")


def cluster_sums(stats: DataFrame, cluster: str, values: list[str]) -> DataFrame:
    """A row a cluster: its sums, its units and its place in the order of the clusters."""
    sums = stats.groupBy(cluster).agg(*[F.sum(v).alias(v) for v in values], F.count(F.lit(1)).alias("units"))
    return sums.withColumns({"slot": F.row_number().over(Window.orderBy(cluster)) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy())})  # a project list


def cluster_draws(sums: DataFrame, replicates: int, seed: str = "0") -> DataFrame:
    """Clusters drawn with replacement, as many as there are, in each replicate: sums' rows by replicate."""
    draws = sums.select("slot", "n").join(sums.sparkSession.range(replicates).withColumnRenamed("id", "replicate"))
    drawn = F.pmod(word32(F.sha2(F.concat_ws("|", F.lit(seed), F.col("replicate"), F.col("slot")), 256)), F.col("n"))
    return draws.select("replicate", drawn.cast("int").alias("slot")).join(sums.drop("n"), "slot")


def cluster_bootstrap(stats: DataFrame, cluster: str, value: str, replicates: int, seed: str = "0") -> DataFrame:
    """(replicate, mean): whole clusters are drawn, each bringing all of its units, from sums a cluster."""
    drawn = cluster_draws(cluster_sums(stats, cluster, [value]), replicates, seed)
    return drawn.groupBy("replicate").agg((F.sum(value) / F.sum("units")).alias("mean"))


def anchor(name: Column, clusters: Column) -> Column:
    """One of the clusters (an array), fixed by the name: the first 64 bits of its hash modulo their number."""
    n, hex_ = F.size(clusters).cast("long"), F.sha2(name, 256)
    high, low = F.pmod(word32(hex_), n), F.pmod(word32(hex_, 1), n)
    index = F.pmod(high * F.pmod(F.lit(1 << 32), n) + low, n)
    return F.element_at(F.sort_array(clusters), (index + 1).cast("int"))


def stability(parts: DataFrame, limit: float) -> DataFrame:
    """Of ``leave_one_out`` rows: the largest absolute change, the source that makes it, and whether all
    changes are within ``limit``."""
    change = F.col("mean") - F.col("whole")
    largest = F.max(F.struct(F.abs(change).alias("size"), change.alias("change"), F.col("source")))
    return parts.agg(largest.alias("m")).select(F.col("m.size").alias("max_abs_delta"), F.col("m.change").alias("signed_delta"), F.col("m.source").alias("most_influential"), (F.col("m.size") <= limit).alias("stable"))


def interval(means: DataFrame, column: str = "mean") -> DataFrame:
    return means.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.percentile(column, 0.025).alias("low"), F.percentile(column, 0.975).alias("high"))


def paired(means: DataFrame) -> DataFrame:
    """Of replicates (a, b): the difference's summary and direction."""
    d = F.col("a") - F.col("b")
    out = means.agg(F.avg(d).alias("delta"), F.percentile(d, 0.025).alias("low"), F.percentile(d, 0.975).alias("high"), F.avg((d > 0).cast("double")).alias("p_above"), F.avg((d >= 0).cast("double")).alias("p_not_below"))
    return out.withColumns({"excludes_zero": (F.col("low") > 0) | (F.col("high") < 0), "direction": F.when(F.col("low") > 0, "BETTER").when(F.col("high") < 0, "WORSE").otherwise("UNDECIDED")})


def leave_one_out(stats: DataFrame, source: str, value: str) -> DataFrame:
    """The mean without each source's rows, from sums: no row is repeated."""
    whole = stats.agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    part = stats.groupBy(source).agg(F.sum(value).alias("sp"), F.count(F.lit(1)).alias("np"))
    return part.crossJoin(F.broadcast(whole)).select(source, ((F.col("s") - F.col("sp")) / (F.col("n") - F.col("np"))).alias("mean"), (F.col("s") / F.col("n")).alias("whole"))


def hash_sample(rows: DataFrame, key: str, stratum: str, size: int, seed: str = "0") -> DataFrame:
    """The first ``size`` rows of each stratum by hash order."""
    ordered = rows.withColumn("order", hash_order(F.col(key), seed))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("order", key))
    return ordered.withColumn("place", place).where(F.col("place") <= size).drop("order")


def split(rows: DataFrame, key: str, quotas: dict[str, int], seed: str = "0") -> DataFrame:
    """Rows (few: one a project) dealt to named splits by hash order, the last split taking the rest."""
    place = F.row_number().over(Window.orderBy(hash_order(F.col(key), seed), key))
    names, upto, out = list(quotas), 0, None
    for name in names[:-1]:
        upto += quotas[name]
        out = F.when(F.col("place") <= upto, name) if out is None else out.when(F.col("place") <= upto, name)
    return rows.withColumn("place", place).withColumn("split", out.otherwise(names[-1]) if out is not None else F.lit(names[-1]))
