"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text.  A text is compressed with
each, in chunks of fixed size (so that a long text cannot become its own dictionary), all of it.  The
normalised difference of the two sizes is calibrated into a probability by logistic regression on
labelled texts that built no dictionary.

Learning reads a bounded sample of labelled rows: about ``DOCS_A_CLASS`` for each label, by hash of id,
their whole texts.  Half of them build dictionaries: their chunks, or of many a share by chance, about
``BYTES_A_CLASS`` for each label, reach the driver.  The other half calibrate: executors compress each
whole text, and one number a text reaches the driver.  Scoring reads the text alone.

* null and empty text: no difference, the calibrated score of that; a label other than 0 or 1, or null:
  not learnt from; a doc_id with both labels teaches both, one label given twice counts once; without
  rows of both labels every score is the smoothed share of label 1;
* repeated rows: scored alike; empty table: no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .langid import fold
from .text import slices

DOCS_A_CLASS, BYTES_A_CLASS, CHUNK, DICTIONARY, LEVEL = 1500, 4 << 20, 2048, 1 << 16, 3


def _chunks(text: bytes) -> list[bytes]:
    return [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]


class Compressors:
    """The compressors of a model: (bad dictionary, good dictionary)."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        self.both = []
        for raw in dictionaries:
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False))

    def difference(self, text: bytes) -> float:
        """(bad - good) / (bad + good) of the compressed sizes: above 0, nearer to good text."""
        bad = good = 0
        for c in _chunks(text):
            bad += len(self.both[0].compress(c))
            good += len(self.both[1].compress(c))
        return (bad - good) / (bad + good) if bad + good else 0.0


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their text itself
        return b"\n".join(samples)[:DICTIONARY] or b" " * 16


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic fit of y (0, 1) on x, slightly held to small slopes, by Newton steps."""
    scale = float(np.abs(x).mean()) or 1.0
    z = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + 0.05 * w
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(2), gradient)
        if np.abs(gradient).max() < 1e-9:
            break
    return float(w[0]) / scale, float(w[1])


def _below(key: Column, share: Column) -> Column:
    """Whether a hash is within the first ``share`` of all."""
    return key / F.lit(float(2**64)) + 0.5 < share


def _by_label(values: dict[int, float]) -> Column:
    return F.when(F.col("quality") == 1, values.get(1, 0.0)).otherwise(values.get(0, 0.0))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(quality, key, text) of about DOCS_A_CLASS rows for each label; ``key`` is a hash of id and text."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null").distinct()
    rows = store.written(rows, "quality-labels")
    many = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    chosen = rows.where(_below(F.xxhash64("doc_id"), _by_label({k: DOCS_A_CLASS / n for k, n in many.items()})))
    # by the shares above, chosen has about 2 * DOCS_A_CLASS rows
    found = docs.join(F.broadcast(chosen), "doc_id").select("quality", F.xxhash64("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    found = store.written(found.dropDuplicates(["quality", "key"]), "quality-sample")
    many = {r["quality"]: r["count"] for r in found.groupBy("quality").count().collect()}  # an id may stand for many texts
    return found.where(_below(F.xxhash64("key"), _by_label({k: 2 * DOCS_A_CLASS / n for k, n in many.items()})))


def _sampled_chunks(rates: dict[int, float]):
    def run(batches):
        for batch, texts in slices(batches):
            labels, out = [], []
            for label, key, text in zip(batch.column("quality").to_pylist(), batch.column("key").to_pylist(), texts):
                chunks = _chunks(text)
                take = np.flatnonzero(np.random.default_rng(key & 0x7FFFFFFFFFFFFFFF).random(len(chunks)) < rates[label])
                labels += [label] * len(take)
                out += [chunks[k] for k in take]
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(out, pa.binary())], names=["quality", "chunk"])

    return run


def _differences(dictionaries):
    def run(batches):
        compressors = Compressors(dictionaries.value)
        for batch, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array([compressors.difference(t) for t in texts], pa.float64())], names=["quality", "x"])

    return run


def train(sample: DataFrame) -> tuple[tuple[bytes, bytes], float, float]:
    """(dictionaries, slope, offset) from rows (quality, key, text)."""
    builds = F.pmod("key", F.lit(2)) == 0
    rows = sample.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.sum(builds.cast("long")).alias("building"), F.sum(F.when(builds, F.octet_length("text"))).alias("bytes"))
    of = {r["quality"]: r for r in rows.collect()}
    many = [of[k]["n"] if k in of else 0 for k in (0, 1)]
    if any(k not in of or not 0 < of[k]["building"] < of[k]["n"] for k in (0, 1)):
        return (b" " * 16, b" " * 16), 0.0, float(np.log((many[1] + 1) / (many[0] + 1)))
    rates = {k: min(1.0, BYTES_A_CLASS / max(1, of[k]["bytes"])) for k in of}
    chunks: dict[int, list[bytes]] = {0: [], 1: []}
    for label, chunk in sorted((r["quality"], bytes(r["chunk"])) for r in sample.where(builds).mapInArrow(_sampled_chunks(rates), "quality int, chunk binary").collect()):
        chunks[label].append(chunk)
    dictionaries = (_dictionary(chunks[0]), _dictionary(chunks[1]))
    shared = sample.sparkSession.sparkContext.broadcast(dictionaries)
    pairs = sorted((r["quality"], r["x"]) for r in sample.where(~builds).mapInArrow(_differences(shared), "quality int, x double").collect())
    return dictionaries, *calibrate(np.array([x for _, x in pairs]), np.array([float(y) for y, _ in pairs]))


def _scored(model):
    def run(batches):
        dictionaries, slope, offset = model.value
        compressors = Compressors(dictionaries)
        for batch, texts in slices(batches):
            x = np.array([compressors.difference(t) for t in texts])
            score = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def quality(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text); rows that are
    ``held_out`` teach nothing."""
    store.prepare(docs.sparkSession)
    held = fold(F.col("doc_id"), 3) == 1 if held_out is None else held_out
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    teaching = labels.select("doc_id", "quality").where(~held)
    model = docs.sparkSession.sparkContext.broadcast(train(labelled_sample(docs, teaching)))
    return docs.withColumn("held_out", held).mapInArrow(_scored(model), "doc_id long, held_out boolean, score double, predicted int")
