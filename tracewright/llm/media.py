"""Media columns: each text as a FLAC stream of 8-bit samples, read back and described.

The payload is the UTF-8 text (null: empty) with zero bytes up to a positive multiple of 64.  The stored
stream is decoded again: Rice residuals and linear predictors, the checksum of every frame and of all
samples; what is returned about the payload comes from the samples read back.

* null and empty text: 64 zero bytes; equal texts give equal values; a damaged stream raises FlacError;
* repeated rows: each is coded; empty table: no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import flac, store
from .text import slices

UNIT = 64
_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: bytes) -> bytes:
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")


def feature(pcm: bytes) -> str:
    """Lowest and highest sample, mean magnitude, sign changes, and loudness of eight equal spans."""
    x = (np.frombuffer(pcm, np.uint8) ^ 0x80).view(np.int8).astype(np.int64)
    spans = np.abs(x[: len(x) // 8 * 8].reshape(8, -1)).sum(1) // max(1, len(x) // 8)
    return f"{x.min()},{x.max()},{int(np.abs(x).sum()) // len(x)},{int(((x[1:] < 0) != (x[:-1] < 0)).sum())}," + ",".join(map(str, spans.tolist()))


def _described(batches):
    for batch, texts in slices(batches):
        stored = flac.encode([payload(t) for t in texts])
        read = flac.decode(stored)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([len(p) for p in read], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in read]),
                pa.array([zlib.crc32(p[-UNIT:]) for p in read], pa.int64()),
                pa.array([len(s) for s in stored], pa.int64()),
                pa.array([hashlib.sha256(s).hexdigest() for s in stored]),
                pa.array([feature(p) for p in read]),
            ],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def _texts(docs: DataFrame) -> DataFrame:
    store.prepare(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")


def media_features(docs: DataFrame) -> DataFrame:
    """The digest columns of each row's stream (see the module's schema)."""
    return _texts(docs).mapInArrow(_described, _SCHEMA)


def media_streams(docs: DataFrame) -> DataFrame:
    """doc_id, media: the stored streams."""

    def run(batches):
        for batch, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(flac.encode([payload(t) for t in texts]), pa.binary())], names=["doc_id", "media"])

    return _texts(docs).mapInArrow(run, "doc_id long, media binary")


def pcm_blocks(streams: DataFrame, block: int = flac.BLOCK) -> DataFrame:
    """doc_id, sample_offset, pcm of ``streams`` (doc_id, media): decoded blocks, each to be sought by its
    first sample."""
    store.prepare(streams.sparkSession)

    def run(batches):
        for batch, media in slices(batches, "media"):
            ids, offsets, blocks = [], [], []
            for i, pcm in zip(batch.column("doc_id").to_pylist(), flac.decode(media)):
                for at in range(0, len(pcm), block):
                    ids.append(i)
                    offsets.append(at)
                    blocks.append(pcm[at : at + block])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(offsets, pa.int64()), pa.array(blocks, pa.binary())], names=["doc_id", "sample_offset", "pcm"])

    return streams.selectExpr("cast(doc_id as long) as doc_id", "media").mapInArrow(run, "doc_id long, sample_offset long, pcm binary")
