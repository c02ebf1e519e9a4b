"""Tables in the folder that all executors share, and filters of fixed size."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a broadcast membership filter, as many as its keys need between these bounds: 16 MB at most,
#: whatever the size of the input.  A fuller filter lets more rows through, never fewer.
LEAST_BITS, FILTER_BITS = 1 << 20, 1 << 27

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Bounded Arrow batches (texts may be long), and this package importable by Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), _ROOT) if x)
        # workers give free memory back: they outlive their tasks, beside the executor's own heap
        env |= {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(1 << 22), "MALLOC_TRIM_THRESHOLD_": str(1 << 24)}
    return spark


def give_back(spark: SparkSession) -> None:
    """Executors collect their heap, which shrinks to what is in use: the collector alone keeps what it has
    taken, up to the largest heap, beside Python workers that come later.  One task a core reaches every
    executor that is idle; collections asked for at once are one."""
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc')").collect()


def shared(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a local one only where that is unset and
    driver and executors are one machine."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "tracewright-shared")
    return path.rstrip("/")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` does not have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the folder's owner clears it
        pass


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends here, and a lost
    executor costs only the tasks that it ran."""
    spark = df.sparkSession
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by sorting both sides: the same plan at every size, and one whose hot keys Spark can split."""
    return left.join(right.hint("merge"), on, how)


def filter_bit(*keys: Column | str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS)).cast("int")


def filter_of(bits: DataFrame, column: str = "bit") -> np.ndarray:
    """A bitmap of the given positions (written rows: they are read twice); at most FILTER_BITS / 64 rows,
    eight keys' worth of bits each, reach the driver."""
    size = min(FILTER_BITS, max(LEAST_BITS, 1 << (8 * bits.count()).bit_length()))
    place = F.col(column).bitwiseAND(F.lit(size - 1))
    words = (
        bits.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toPandas()
    )
    out = np.zeros(size // 64, np.int64)
    out[words["w"].to_numpy(int)] = words["b"].to_numpy(np.int64)
    return out.view(np.uint64)


def hits(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    bit = bit.astype(np.int64) & (64 * len(bitmap) - 1)
    return (bitmap[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1


def in_filter(spark: SparkSession, bitmap: np.ndarray, bit: Column) -> Column:
    """Whether the filter may hold it: no false negatives."""
    shared_map = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def test(b: pd.Series) -> pd.Series:
        return pd.Series(hits(shared_map.value, b.to_numpy()))

    return test(bit)
