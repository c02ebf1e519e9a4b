"""Exact dedup by counting quotient filters.

Each partition of the fingerprint table builds a counting quotient filter: the high bits of a 64-bit
fingerprint are its quotient, the low bits its remainder.  A remainder sits in the slot of its quotient or
as near behind it as there is room; runs of equal quotient hold remainders in order, and a counter above
one fills slots behind its remainder.  One bit a quotient says whether it has a run, one bit a slot whether
a run ends there and one whether it is of a counter.  Filters are cut into blocks of neighbouring
quotients; blocks of all partitions, whatever their numbers of slots, merge losslessly by their sorted
remainders.  Fingerprints that end with a count above one
route their texts, and no others, to verification: a grouping by the bytes themselves, pre-aggregated
before the shuffle, so that a group of copies of any size reaches a reducer as one row a map task.

Texts are equal when identical after lower-casing A-Z only; null counts as empty.

* empty table: no rows; empty and null texts: equal to each other, one group;
* repeated doc_id: with unlike texts they are two documents; with equal text all of those rows carry
  the same decision (``drop_copies`` then leaves one of them);
* null doc_id: loses to every other, so a group of nothing else has a null ``keep_id`` and keeps all
  its rows; columns beside doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .text import slices

#: Fingerprints that a block of merged quotients holds on average, and entries a slot that a filter is built for.
BLOCK_ENTRIES, LOAD = 1 << 15, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class CountingQuotientFilter:
    """The slots of a block of neighbouring quotients: remainders in sorted runs, with their counters."""

    def __init__(self, quotient_bits: int, first: int, occupied: np.ndarray, run_end: np.ndarray, counter: np.ndarray, slot: np.ndarray):
        self.quotient_bits, self.first, self.occupied, self.run_end, self.counter, self.slot = quotient_bits, first, occupied, run_end, counter, slot
        self.bits = 64 - quotient_bits

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray, quotient_bits: int, block: int = 0, block_bits: int = 0) -> CountingQuotientFilter:
        """Of distinct fingerprints in order, all of one block (their first ``block_bits`` bits)."""
        bits = 64 - quotient_bits
        shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
        first, quotients = block << (quotient_bits - block_bits), 1 << (quotient_bits - block_bits)
        quotient = (fingerprints >> shift).astype(np.int64) - first
        rest = np.where(counts > 1, counts, 0).astype(np.uint64)
        digits, left = np.zeros(len(rest), np.int64), rest.copy()
        while left.any():
            digits += left > 0
            left >>= shift
        size = 1 + digits
        begin = np.flatnonzero(np.concatenate(([True], quotient[1:] != quotient[:-1]))) if len(quotient) else np.zeros(0, int)
        length = np.add.reduceat(size, begin) if len(begin) else np.zeros(0, int)
        before = np.cumsum(length) - length
        start = before + np.maximum.accumulate(quotient[begin] - before) if len(begin) else before
        slots = max(quotients, int(start[-1] + length[-1]) if len(begin) else 0)
        slot, counter, run_end, occupied = np.zeros(slots, np.uint64), np.zeros(slots, bool), np.zeros(slots, bool), np.zeros(quotients, bool)
        place = np.cumsum(size) - size
        place += np.repeat(start - place[begin], np.diff(np.append(begin, len(quotient))))
        slot[place] = fingerprints & mask
        for k in range(int(digits.max(initial=0))):
            has = digits > k
            slot[place[has] + 1 + k] = rest[has] >> np.uint64(k * bits) & mask
            counter[place[has] + 1 + k] = True
        run_end[start + length - 1] = True
        occupied[quotient] = True
        return cls(quotient_bits, first, occupied, run_end, counter, slot)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints in order, counts)."""
        quotient, end = np.flatnonzero(self.occupied), np.flatnonzero(self.run_end)
        start = np.maximum(quotient, np.concatenate(([0], end[:-1] + 1))) if len(end) else end
        length = end - start + 1
        used = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        own = np.repeat(quotient, length)
        entry = ~self.counter[used]
        number = np.cumsum(entry) - 1
        head = np.flatnonzero(entry)
        fingerprints = (own[head] + self.first).astype(np.uint64) << np.uint64(self.bits) | self.slot[used[head]]
        counts = np.zeros(len(head), np.uint64)
        digit = np.flatnonzero(~entry)
        np.add.at(counts, number[digit], self.slot[used[digit]] << ((digit - head[number[digit]] - 1) * self.bits).astype(np.uint64))
        return fingerprints, np.maximum(counts, 1).astype(np.int64)

    def pack(self) -> bytes:
        head = np.array([self.quotient_bits, self.first, len(self.occupied), len(self.slot)], np.int64)
        bits = np.unpackbits(self.slot.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - self.bits :]
        return b"".join((head.tobytes(), *(np.packbits(x).tobytes() for x in (self.occupied, self.run_end, self.counter, bits))))

    @classmethod
    def unpack(cls, data: bytes) -> CountingQuotientFilter:
        quotient_bits, first, quotients, slots = np.frombuffer(data, np.int64, 4).tolist()
        at, parts = 32, []
        for n in (quotients, slots, slots, slots * (64 - quotient_bits)):
            parts.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n))
            at += -(-n // 8)
        wide = np.zeros((slots, 64), np.uint8)
        wide[:, quotient_bits:] = parts[3].reshape(slots, 64 - quotient_bits)
        return cls(quotient_bits, first, *(x.astype(bool) for x in parts[:3]), np.packbits(wide, axis=1).view(">u8").ravel().astype(np.uint64))


def sorted_counts(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in order, with their counts."""
    return np.unique(fingerprints, return_counts=True)


def blocks_of(fingerprints: np.ndarray, counts: np.ndarray, block_bits: int):
    """(block, filter) for each block that has one of these fingerprints (distinct, in order)."""
    bits = max(1, block_bits, math.ceil(math.log2(max(2.0, len(fingerprints) / LOAD))))
    block = (fingerprints >> np.uint64(64 - block_bits)).astype(np.int64) if block_bits else np.zeros(len(fingerprints), np.int64)
    cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else block
    for a, b in zip(cuts, np.append(cuts[1:], len(block))):
        yield int(block[a]), CountingQuotientFilter.of(fingerprints[a:b], counts[a:b], bits, int(block[a]), block_bits)


def merged_entries(filters: list[CountingQuotientFilter]) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints in order, counts) of all filters: two at a time, by their sorted remainders."""
    runs = [f.entries() for f in filters]
    while len(runs) > 1:
        runs = [_two(*pair) if len(pair) == 2 else pair[0] for pair in (runs[k : k + 2] for k in range(0, len(runs), 2))]
    return runs[0]


def _two(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.empty(len(a[0]) + len(b[0]), np.uint64), np.empty(len(a[0]) + len(b[0]), np.int64)
    for (k, n), place in ((a, np.arange(len(a[0])) + np.searchsorted(b[0], a[0], "left")), (b, np.arange(len(b[0])) + np.searchsorted(a[0], b[0], "right"))):
        keys[place], counts[place] = k, n
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def _digests(batches):
    for batch, texts in slices(batches):
        digest = [hashlib.sha256(t.lower()).digest() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.array([int.from_bytes(d[:8], "big", signed=True) for d in digest], np.int64)), pa.array([d.hex() for d in digest])],
            names=["doc_id", "fp", "text_sha256"],
        )


def _filters(block_bits: int):
    def build(frames):
        parts = [f["fp"].to_numpy(np.int64) for f in frames]
        if parts and sum(map(len, parts)):
            blocks = list(blocks_of(*sorted_counts(np.concatenate(parts).view(np.uint64)), block_bits))
            yield pd.DataFrame({"block": [k for k, _ in blocks], "filter": [f.pack() for _, f in blocks]})

    return build


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    fingerprints, counts = merged_entries([CountingQuotientFilter.unpack(x) for x in group["filter"]])
    often = counts > 1
    return pd.DataFrame({"fp": fingerprints[often].view(np.int64), "n": counts[often]})


def repeated_fingerprints(digests: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of every fingerprint that more than one row has."""
    block_bits = min(40, max(0, math.ceil(math.log2(max(rows, 1) / BLOCK_ENTRIES + 1e-9))))
    filters = digests.select("fp").mapInPandas(_filters(block_bits), "block long, filter binary")
    return filters.groupBy("block").applyInPandas(_merged, "fp long, n long")


def _candidates(shared_map):
    def emit(batches):
        bitmap = shared_map.value
        for batch, texts in slices(batches):
            lowered = [t.lower() for t in texts]
            digest = [hashlib.sha256(t).digest() for t in lowered]
            fp = np.array([int.from_bytes(d[:8], "big", signed=True) for d in digest], np.int64)
            take = np.flatnonzero(store.hits(bitmap, fp & (store.FILTER_BITS - 1)))
            if len(take):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(take)), pa.array([digest[i].hex() for i in take]), pa.array([lowered[i] for i in take], pa.binary())],
                    names=["doc_id", "text_sha256", "bytes"],
                )

    return emit


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs`` (doc_id, text)."""
    spark = store.prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digests = store.written(docs.mapInArrow(_digests, "doc_id long, fp long, text_sha256 string"), "dedup-digests")
    often = store.written(repeated_fingerprints(digests, digests.count()), "dedup-often")
    bitmap = store.filter_of(often.select((F.col("fp").bitwiseAND(F.lit(store.FILTER_BITS - 1))).alias("bit")))
    routed = docs.mapInArrow(_candidates(spark.sparkContext.broadcast(bitmap)), "doc_id long, text_sha256 string, bytes binary")
    groups = routed.groupBy("text_sha256", "bytes").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id")).where("group_size > 1").drop("bytes")
    groups = store.written(groups, "dedup-groups")
    single = F.col("group_size").isNull()
    return digests.transform(store.merged, groups, "text_sha256", "left").select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one row of each group of equal texts, all columns kept, whatever their
    names.  Only rows of such groups are dealt anew; the others stay where they are.  Null texts are empty
    texts; of rows with the same doc_id and text one stays; a group without any doc_id keeps one row."""
    spark = docs.sparkSession
    found = store.written(exact_dedup(docs).where("group_size > 1").select("doc_id", "kept", "text_sha256").distinct(), "dedup-decisions")
    bitmap = store.filter_of(found.select(store.filter_bit("doc_id").alias("bit")))
    maybe, sha, own, key, stays = store.unused(docs, "maybe", "sha", "own", "key", "stays")
    flagged = docs.withColumn(maybe, store.in_filter(spark, bitmap, store.filter_bit(F.col("doc_id").cast("long"))))
    some = flagged.where(F.col(maybe)).withColumn(sha, F.sha2(normalised(F.col("text").cast("string")), 256))
    known = found.select(F.col("doc_id").alias(own), F.col("text_sha256").alias(key), F.col("kept").alias(stays))
    some = some.transform(store.merged, known, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.col(sha) == F.col(key)), "left")
    alone, grouped = some.where(F.col(stays).isNull()), some.where(F.col(stays)).dropDuplicates(["doc_id", sha])
    return flagged.where(~F.col(maybe)).select(*docs.columns).unionByName(alone.select(*docs.columns)).unionByName(grouped.select(*docs.columns))
