"""Registry hygiene: duplicates, identities, survival, collisions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import set_verdict


def duplicate_groups(components: DataFrame, *by: str) -> DataFrame:
    """Contents that more than one project holds."""
    return components.groupBy(*by, "sha").agg(F.countDistinct("project").alias("projects"), F.count(F.lit(1)).alias("components"), F.min("project").alias("first_project")).where("projects > 1")


def identity_hits(queries: DataFrame, gallery: DataFrame, key: str) -> DataFrame:
    """Each query's verdict by the projects that share its ``key``."""
    found = gallery.groupBy(key).agg(F.collect_set("project").alias("found"))
    joined = queries.join(found, key, "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    return joined.select("id", "project", F.size("found").cast("long").alias("candidates"), set_verdict(F.col("found"), F.col("project")).alias("verdict"))


def survival(old: DataFrame, new: DataFrame) -> DataFrame:
    """What became of each old component: content at the same path, moved, or changed or removed; and to
    whom its content would be attributed."""
    same = new.select("project", "path", "sha").distinct().withColumn("same", F.lit(True))
    moved = new.select("project", "sha").distinct().withColumn("held", F.lit(True))
    owners = new.groupBy("sha").agg(F.collect_set("project").alias("owners"))
    rows = old.join(same, ["project", "path", "sha"], "left").join(moved, ["project", "sha"], "left").join(owners, "sha", "left")
    state = F.when(F.col("same"), "UNCHANGED_SAME_PATH").when(F.col("held"), "UNCHANGED_MOVED_PATH").otherwise("CHANGED_OR_REMOVED")
    n = F.coalesce(F.size("owners"), F.lit(0))
    who = F.when(n <= 0, "NO_EXACT_MATCH").when((n == 1) & F.array_contains("owners", F.col("project")), "CORRECT_PARENT").when(n == 1, "WRONG_PARENT").otherwise("AMBIGUOUS")
    return rows.select("id", "project", state.alias("state"), who.alias("attribution"))


def _simhash128(batches):
    """Weighted sign sums a row: tokens are hashed once a batch, counted in the row."""
    for batch in batches:
        lists = batch.column("tokens")
        texts = pc.fill_null(lists.flatten(), "").dictionary_encode()
        digests = b"".join(hashlib.sha256(t.encode()).digest()[:16] for t in texts.dictionary.to_pylist())
        signs = 2 * np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 16), axis=1).astype(np.int64) - 1
        code = np.asarray(texts.indices)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64))
        keep, words = [], []
        for row, end in enumerate(ends):
            begin = ends[row - 1] if row else 0
            if end > begin:
                own, count = np.unique(code[begin:end], return_counts=True)
                keep.append(row)
                words.append(np.packbits(count @ signs[own] >= 0).view(">u4").astype(np.int64))
        words = np.stack(words) if words else np.zeros((0, 4), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), *(pa.array(words[:, k]) for k in range(4))], names=[batch.schema.names[0], "w0", "w1", "w2", "w3"])


def simhash128(rows: DataFrame, key: str, tokens: str, most: int = 100_000) -> DataFrame:
    """128-bit weighted SimHash over the first 128 bits of SHA-256, most significant first, as four 32-bit
    words; no tokens, no row.  ``most`` tokens are read (a value of the method).  No shuffle."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.slice(F.col(tokens), 1, most).alias("tokens")).mapInArrow(_simhash128, f"`{key}` {kind}, w0 long, w1 long, w2 long, w3 long")
